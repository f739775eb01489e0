"""Language-model scoring by Ziv-Merhav cross-parsing of every document against the rest of the corpus.

Words are the symbols. Greedy longest matches in the reference factor a document into c phrases; a word that the
reference lacks is a phrase. With n words and s phrases of the document's own incremental (LZ78) parsing, the score is
the Ziv-Merhav estimate of relative entropy in bits a word, (c log2 m - s log2 s) / n: what the document costs as
pointers into the reference, less its own entropy. m is the reference's length in words, or n if that is more (the
published form has m = n, where a text of nothing but unheard words would score 0). Lower is closer to the reference.

The reference is every other document (or every other trusted one): a document is left out of its own reference, and a
repeated row isn't. No task holds all of it. Its suffix automaton is held to depth DEPTH as a distributed table: a state
is a run of k words that occurs in the reference, named by its hash, and there is a transition from a run to one that is
longer by a word if the table has both. All places of all documents take their k-th transition in the same round, so
a round is one shuffle of the hashes that are still of interest, and the work is proportional to the corpus.

With ``exact``, as in the query, longer matches are the longest ones too, whatever their length. If each occurrence of the
run of DEPTH words at place i + 1 follows the same word, the match at i is the one at i + 1 and a word, so only places
before a run with several left neighbours are open. These descend the trie of their continuations by doubling and halving:
the places that share a run of lo words compare the next length between lo and hi; those that meet another document there
go on above it, the others below, with two documents of each run that was met. The first round is for all that a place
may match, up to where the runs of DEPTH words end that others have; equal places are two from then on. There are about
two rounds for each doubling of the longest match, and a round moves what open places ask.

Without ``exact``, a match beyond DEPTH words goes on by suffix link and transition: the first word is dropped and the next
one appended, as long as the run of the last DEPTH words is in the reference. Then a match of more than DEPTH words may
also join two that overlap in DEPTH - 1 words.

Documents are dealt to blocks of about BLOCK_BYTES as they are read. A block keeps its words as numbers with their hashes
(its only copy from then on), and asks for each distinct run once, whatever the number of places, so a hot run is a row
for each block. Asked runs meet in buckets by hash; a bucket answers whether none, one or more documents of the
reference have a run, which is all that leaving oneself out takes.

Edge cases: a null or empty text has no words, no phrases and a null score; a null doc_id is never trusted; rows that
share a doc_id are scored one by one; a text longer than a block is a block of its own; without any reference every word
is a phrase; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, checkpointed, chunks, mix64, placed, sweep
from tidemark.llm.words import Words

#: Depth of the automaton in words; text in a block, in bytes; about the asked runs in a bucket.
DEPTH, BLOCK_BYTES, BUCKET_RUNS = 8, 4 << 20, 1 << 19
#: About the words that open places may match in a partition.
PART_WORDS = 1 << 19
_STEP = np.uint64(0xD1342543DE82EF95)
#: What goes between blocks and buckets: runs with counts of documents. Rows of bucket -1 hold a block's matches so far.
_MESSAGE = "block long, bucket int, n int, runs binary, counts binary, before binary"
#: A block after the last of these rounds: its matches so far, those that are one longer than the next, and the open places
#: with their documents, where they are in ``deep`` (the words that they may match) and how many words of it they may match.
_DEEP = (
    "block long, n_words long, doc_ids array<long>, lengths array<int>, own_phrases array<int>, trusted binary, matches binary, chained binary, "
    "n_places int, places binary, docs binary, needy binary, starts binary, reach binary, n_deep long, deep binary"
)
#: What open places ask. Rows of bucket -1 hold a block's tasks (place, lo, hi, needy), rows of bucket -2 its matches so far.
_QUESTION = "block long, bucket int, n int, keys binary, tests binary, docs binary, flags binary"
_OPEN = (1 << 31) - 1
_STATE = (
    "block long, n_words long, n_reference long, n_hashes long, doc_ids array<long>, lengths array<int>, own_phrases array<int>, "
    "trusted binary, hashes binary, words binary"
)
_RESULT = "doc_id long, n_words long, n_phrases long, n_own_phrases long, score double"


def own_phrases(symbols: list[int]) -> int:
    """How many phrases incremental parsing cuts the sequence into; a last phrase met before counts."""
    seen: dict[int, int] = {}
    phrases = node = 0
    for c in symbols:
        child = seen.get(node << 32 | c)
        if child is None:
            phrases += 1
            seen[node << 32 | c] = phrases
            node = 0
        else:
            node = child
    return phrases + (node > 0)


def greedy_phrases(lengths: np.ndarray) -> int:
    """How many phrases the greedy longest matches cut a sequence into, given the longest match at each place."""
    steps, phrases, i = np.maximum(lengths, 1).tolist(), 0, 0
    while i < len(steps):
        phrases, i = phrases + 1, i + steps[i]
    return phrases


def entropy(n: int, cross: int, own: int, reference: int) -> float | None:
    """The estimate in bits a word; None without words."""
    return (cross * log2(max(n, reference)) - own * log2(own)) / n if n else None


def _pack(x: np.ndarray) -> bytes:
    """An array of numbers, its bytes by place so that they compress."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.array(planes.T, order="C").view(kind).ravel()


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


class _Block:
    """The documents of a row of the state: for each word its hash, its document, and the words left in that."""

    def __init__(self, row: dict):
        self.row, self.n = row, row["n_words"]
        lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(lengths)
        self.hash = _unpack(row["hashes"], row["n_hashes"], np.uint64)[_unpack(row["words"], self.n, np.uint32)]
        self.trusted = np.frombuffer(row["trusted"], np.bool_)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.left = self.ends[self.doc] - np.arange(self.n)

    def places(self, useful: np.ndarray, k: int) -> np.ndarray:
        """The places whose run of k words is of interest: those of both runs of k - 1 words in it are."""
        fits = self.left >= k
        if k > 2:
            fits &= useful
            fits[:-1] &= useful[1:]
        return np.flatnonzero(fits)

    def runs(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs of k words at some places, in order; the run of each place; and the counts of each run: the
        trusted documents that have it, plus 3 times all documents, both up to 2."""
        gram = self.hash[places]
        for j in range(1, k):
            gram = mix64(gram * _STEP + self.hash[places + j])
        order = np.argsort(gram)
        ordered, doc = gram[order], self.doc[places][order]
        first = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        at = np.empty(len(gram), np.int64)
        at[order] = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        if not len(starts):
            return ordered, at, np.empty(0, np.uint8)
        everyone = 1 + (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
        sure = everyone
        if not self.trusted.all():
            mine = self.trusted[doc]
            least, most = np.minimum.reduceat(np.where(mine, doc, len(self.trusted)), starts), np.maximum.reduceat(np.where(mine, doc, -1), starts)
            sure = (most >= 0).astype(np.int64) + (least < most)
        return ordered[starts], at, (sure + 3 * everyone).astype(np.uint8)

    def before(self, places: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` runs, the hash of the word before all of its places; 0 if there are several or none."""
        begins = np.append(0, self.ends)[self.doc[places]] == places
        word = np.where(begins, np.uint64(0), self.hash[places - 1])
        one, same = np.zeros(n, np.uint64), np.ones(n, np.bool_)
        one[at] = word
        same[at[one[at] != word]] = False
        return np.where(same, one, np.uint64(0))


def _states(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text, trusted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, block in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            found, counts = [np.empty(0, np.uint64)], []
            for piece in chunks(iter([block]), "text"):
                words = Words(piece.column("text"), fold=True)
                found.append(words.hash)
                counts.append(np.bincount(words.row, minlength=piece.num_rows))
            hashes, ids = np.unique(np.concatenate(found), return_inverse=True)
            lengths = np.concatenate(counts)
            trusted = block.column("trusted").to_numpy(zero_copy_only=False).astype(np.bool_)
            bounds = np.append(0, np.cumsum(lengths)).tolist()
            row = {
                "block": part << 32 | i, "n_words": len(ids), "n_reference": int(lengths[trusted].sum()), "n_hashes": len(hashes),
                "doc_ids": block.column("doc_id").to_pylist(), "lengths": lengths.tolist(),
                "own_phrases": [own_phrases(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)],
                "trusted": trusted.tobytes(), "hashes": _pack(hashes), "words": _pack(ids.astype(np.uint32)),
            }
            yield pa.RecordBatch.from_pylist([row], _arrow(_STATE))

    return bounded(docs).mapInArrow(run, _STATE)


def _edges(buckets: int) -> np.ndarray:
    """The first hash of every bucket; buckets are ranges of hashes."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def _asked(block: _Block, lengths: np.ndarray, useful: np.ndarray, k: int, buckets: int, before: bool = False) -> Iterator[dict]:
    """What a block asks in round k, a row for each bucket, and its matches so far; if ``before``, with left neighbours."""
    number = block.row["block"]
    yield {"block": number, "bucket": -1, "n": block.n, "runs": _pack(lengths), "counts": _pack(useful)}
    places = block.places(useful, k)
    runs, at, counts = block.runs(places, k)
    left = block.before(places, at, len(runs)) if before else None
    edges = _edges(buckets)
    bounds = [*np.searchsorted(runs, edges).tolist(), len(runs)]
    for b, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if end > start:
            # Differences of rising hashes are smaller numbers.
            steps = np.diff(runs[start:end], prepend=edges[b])
            sides = {"before": _pack(left[start:end])} if before else {}
            yield {"block": number, "bucket": b, "n": end - start, "runs": _pack(steps), "counts": _pack(counts[start:end]), **sides}


def _answered(rows: pa.Table) -> pa.Table:
    """For every run that is asked in a bucket, the counts over all blocks, plus 9 if one word is before all of its places; a
    block's matches pass through."""
    out = rows.select(_arrow(_MESSAGE).names).to_pylist()
    asked = [r for r in out if r["bucket"] >= 0]
    if asked:
        # All start from the bucket's first hash, so what counts is the distance from it.
        runs = np.concatenate([np.cumsum(_unpack(r["runs"], r["n"], np.uint64), dtype=np.uint64) for r in asked])
        counts = np.concatenate([_unpack(r["counts"], r["n"], np.uint8) for r in asked]).astype(np.int64)
        order = np.argsort(runs)
        first = np.append(True, np.diff(runs[order]) != 0)
        sums = [np.minimum(np.add.reduceat(part[order], np.flatnonzero(first)), 2) for part in (counts % 3, counts // 3)]
        total = np.empty(len(runs), np.uint8)
        if asked[0]["before"] is not None:
            left = np.concatenate([_unpack(r["before"], r["n"], np.uint64) for r in asked])[order]
            least = np.minimum.reduceat(left, np.flatnonzero(first))
            sums.append((least > 0) & (least == np.maximum.reduceat(left, np.flatnonzero(first))))
        else:
            sums.append(np.zeros(len(sums[0]), np.bool_))
        total[order] = (sums[0] + 3 * sums[1] + 9 * sums[2])[np.cumsum(first) - 1]
        ends = np.cumsum([r["n"] for r in asked]).tolist()
        for r, end in zip(asked, ends, strict=True):
            r |= {"runs": b"", "counts": _pack(total[end - r["n"] : end]), "before": None}
    return pa.Table.from_pylist(out, _arrow(_MESSAGE))


def _advanced(block: _Block, answers: list[dict], k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches of a block after round k: the longest so far at each place, where a longer run is of interest, and where one
    word is before all places of the run of k."""
    before = next(a for a in answers if a["bucket"] < 0)
    lengths, useful = _unpack(before["runs"], block.n, np.uint8), _unpack(before["counts"], block.n, np.bool_)
    places = block.places(useful, k)
    runs, at, _ = block.runs(places, k)
    starts = np.searchsorted(runs, _edges(buckets)).tolist()
    total = np.zeros(len(runs), np.uint8)
    for a in answers:
        if (b := a["bucket"]) >= 0:
            total[starts[b] : starts[b] + a["n"]] = _unpack(a["counts"], a["n"], np.uint8)
    total, one, mine = total[at] % 9, total[at] > 8, block.trusted[block.doc[places]]
    # A document has its own runs, so it counts among those that do.
    known = total % 3 > mine
    lengths[places[known]] = k
    # A run is also of interest as long as it may tell others something.
    useful = np.zeros(block.n, np.bool_)
    useful[places] = known | mine & (total // 3 > 1)
    follows = np.zeros(block.n, np.bool_)
    follows[places] = one
    return lengths, useful, follows


def match_lengths(lengths: np.ndarray, depth: int) -> np.ndarray:
    """The match at each place, given the longest up to a depth: deeper ones go on while the next place is that deep too."""
    at = np.arange(len(lengths))
    stop = np.minimum.accumulate(np.where(lengths < depth, at, len(at))[::-1])[::-1]
    return np.where(lengths < depth, lengths, stop - at + depth - 1)


def _deepened(block: _Block, lengths: np.ndarray, useful: np.ndarray, follows: np.ndarray, depth: int) -> dict:
    """The row of a block after round ``depth``. A place is open if the run after it has several left neighbours; all places
    that share more than ``depth`` words with it are open too."""
    after = lambda x: np.append(x[1:], False)
    deep = lengths == depth
    goes_on = deep & after(deep)
    places = np.flatnonzero(useful & after(useful) & ~after(follows))
    reach = match_lengths(np.where(useful, depth, 0), depth)[places]
    cover = np.zeros(block.n + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + reach, -1)
    kept = np.cumsum(cover[:-1]) > 0
    words = block.hash[kept]
    row = {name: block.row[name] for name in ("block", "n_words", "doc_ids", "lengths", "own_phrases", "trusted")}
    return row | {
        "matches": _pack(lengths), "chained": _pack(goes_on & after(follows)), "n_places": len(places), "places": _pack(places.astype(np.uint32)),
        "docs": _pack(block.doc[places].astype(np.uint32)), "needy": _pack(goes_on[places]), "starts": _pack((np.cumsum(kept) - 1)[places].astype(np.uint32)),
        "reach": _pack(reach.astype(np.int32)), "n_deep": len(words), "deep": _pack(words),
    }


def _named(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of runs of any lengths, each from two runs of the greatest power of 2 in it."""
    out = np.empty(len(at), np.uint64)
    power = np.frexp(lengths)[1] - 1
    level, size = words, 1
    for j in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == j)
        a, n = at[mine], lengths[mine]
        out[mine] = mix64(mix64(level[a] * _STEP + level[a + n - size]) + n.astype(np.uint64))
        if (power > j).any():
            level, size = mix64(level[:-size] * _STEP + level[size:]), 2 * size
    return out


def _middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The length to compare between ``lo``, which is met, and ``hi``, which isn't; twice ``lo`` if nothing is known above."""
    return np.where(hi == _OPEN, 2 * lo, (lo + hi) // 2)


def _questions(row: dict, tasks: list[np.ndarray], found: np.ndarray, buckets: int, whole: bool = False) -> list[dict]:
    """What a block asks for its tasks (place, lo, hi, needy), in order of their keys, a row for each bucket, its tasks and
    matches so far. If ``whole``, places compare all that they may match."""
    n = row["n_places"]
    place, lo, hi, needy = tasks
    starts, reach = (_unpack(row["starts"], n, np.uint32).astype(np.int64)[place], _unpack(row["reach"], n, np.int32)[place])
    middle = reach.astype(np.int64) if whole else _middle(lo, hi)
    fits = reach >= middle
    names = _named(_unpack(row["deep"], row["n_deep"], np.uint64), np.append(starts, starts[fits]), np.append(lo, middle[fits]))
    keys = mix64(mix64(names[: len(place)] * _STEP + lo.astype(np.uint64)) + hi.astype(np.uint64))
    # A run that ends before meets no other, so its hash is its own.
    tests = mix64(mix64(np.full(len(place), row["block"], np.uint64) * _STEP + place.astype(np.uint64)) ^ _STEP)
    tests[fits] = names[len(place) :]
    docs = _unpack(row["docs"], n, np.uint32)[place]
    flags = (np.frombuffer(row["trusted"], np.bool_)[docs] + 2 * needy).astype(np.uint8)
    order = np.argsort(keys)
    place, lo, hi, needy, keys, tests, docs, flags = (x[order] for x in (place, lo, hi, needy, keys, tests, docs, flags))
    edges = _edges(buckets)
    bounds = [*np.searchsorted(keys, edges).tolist(), len(keys)]
    out = [{"block": row["block"], "bucket": -2, "n": n, "keys": _pack(found.astype(np.int32))}]
    packed = (_pack(place.astype(np.uint32)), _pack(lo.astype(np.int32)), _pack(hi.astype(np.int32)), _pack(needy.astype(np.uint8)))
    out.append({"block": row["block"], "bucket": -1, "n": len(place), **dict(zip(("keys", "tests", "docs", "flags"), packed, strict=True))})
    for b, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if end > start:
            packed = (_pack(np.diff(keys[start:end], prepend=edges[b])), *(_pack(x[start:end]) for x in (tests, docs, flags)))
            out.append({"block": row["block"], "bucket": b, "n": end - start, **dict(zip(("keys", "tests", "docs", "flags"), packed, strict=True))})
    return out


def _met(rows: pa.Table, whole: bool = False) -> pa.Table:
    """For every task that is asked in a bucket: 1 to go on above the length compared, 2 if it needs the result there, 4 and 8
    for below, 16 if no other document of the reference shares its key. A block's own rows pass through.

    If ``whole``: 1 to go on, 2 if it needs a result, 32 if it has it: another document of the reference has all that it may
    match. Of such equal places, one for each of two documents answers for all."""
    out = rows.select(_arrow(_QUESTION).names).to_pylist()
    asked = [r for r in out if r["bucket"] >= 0]
    if asked:
        key = np.concatenate([np.cumsum(_unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in asked])
        test = np.concatenate([_unpack(r["tests"], r["n"], np.uint64) for r in asked])
        doc = np.concatenate([_unpack(r["docs"], r["n"], np.uint32).astype(np.int64) + (i << 32) for i, r in enumerate(asked)])
        flags = np.concatenate([_unpack(r["flags"], r["n"], np.uint8) for r in asked])
        order = np.lexsort((test, key))
        key, test, doc, flags = (x[order] for x in (key, test, doc, flags))
        sure, needy = flags % 2 > 0, flags > 1
        new_key = np.append(True, key[1:] != key[:-1])
        new_run = new_key | np.append(True, test[1:] != test[:-1])

        def others(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The group of each task, whether its group has another document of the reference, and the first and last such."""
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            least = np.minimum.reduceat(np.where(sure, doc, np.iinfo(np.int64).max), starts)[group]
            most = np.maximum.reduceat(np.where(sure, doc, -1), starts)[group]
            return group, (most >= 0) & ((least != doc) | (most != doc)), least, most

        keyed, company, _, _ = others(new_key)
        run, met, least, most = others(new_run)
        above, below = needy & met, needy & ~met & company
        # One place for each of two documents answers for a run below.
        speaks = np.zeros(len(key), np.bool_)
        for edge in (least, most):
            mine = np.flatnonzero(sure & (doc == edge))
            speaks[mine[np.append(True, run[mine][1:] != run[mine][:-1])[: len(mine)]]] = True
        alive = np.logical_or.reduceat(below, np.flatnonzero(new_key))[keyed]
        up = above | sure & np.logical_or.reduceat(above, np.flatnonzero(new_run))[run]
        down = below | speaks & alive
        answer = np.empty(len(key), np.uint8)
        answer[order] = down + 2 * below + 32 * above if whole else up + 2 * above + 4 * down + 8 * below + 16 * (needy & ~met & ~company)
        ends = np.cumsum([r["n"] for r in asked]).tolist()
        for r, end in zip(asked, ends, strict=True):
            r |= {"keys": None, "tests": None, "docs": None, "flags": _pack(answer[end - r["n"] : end])}
    return pa.Table.from_pylist(out, _arrow(_QUESTION))


def _descended(row: dict, answers: list[dict], whole: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's next tasks and its matches so far."""
    by = {a["bucket"]: a for a in answers}
    found, tasks = _unpack(by[-2]["keys"], row["n_places"], np.int32), by[-1]
    n = tasks["n"]
    place, lo, hi = _unpack(tasks["keys"], n, np.uint32), _unpack(tasks["tests"], n, np.int32).astype(np.int64), _unpack(tasks["docs"], n, np.int32).astype(np.int64)
    answer = np.concatenate([np.empty(0, np.uint8), *(_unpack(by[b]["flags"], by[b]["n"], np.uint8) for b in sorted(by) if b >= 0)])
    if whole:
        done, stays = place[answer & 32 > 0], answer & 1 > 0
        found[done] = _unpack(row["reach"], row["n_places"], np.int32)[done]
        return [place[stays], lo[stays], hi[stays], (answer & 2 > 0)[stays]], found
    middle = _middle(lo, hi)
    for done, length in ((answer & 16 > 0, lo), ((answer & 8 > 0) & (middle - lo == 1), lo), ((answer & 2 > 0) & (hi - middle == 1), middle)):
        found[place[done]] = length[done]
    up, down = (answer & 1 > 0) & (hi - middle > 1), (answer & 4 > 0) & (middle - lo > 1)
    both = lambda a, b: np.concatenate([a[up], b[down]])
    return [both(place, place), both(middle, lo), both(hi, middle), both(answer & 2 > 0, answer & 8 > 0)], found


def _longest(row: dict, found: np.ndarray) -> np.ndarray:
    """The match at each place of a block, given those at its open places."""
    n = row["n_words"]
    lengths, at = _unpack(row["matches"], n, np.uint8).astype(np.int64), np.arange(n)
    needy = _unpack(row["needy"], row["n_places"], np.bool_)
    lengths[_unpack(row["places"], row["n_places"], np.uint32)[needy]] = found[needy]
    end = np.minimum.accumulate(np.where(_unpack(row["chained"], n, np.bool_), n, at)[::-1])[::-1]
    return lengths[end] + end - at


def _scored(row: dict, lengths: np.ndarray, reference: int) -> pa.Table:
    bounds, trusted = np.append(0, np.cumsum(row["lengths"], dtype=np.int64)).tolist(), np.frombuffer(row["trusted"], np.bool_)
    rows = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        n, own, cross = b - a, row["own_phrases"][i], greedy_phrases(lengths[a:b])
        rows.append((row["doc_ids"][i], n, cross, own, entropy(n, cross, own, reference - n * bool(trusted[i]))))
    schema = _arrow(_RESULT)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def cross_parse(docs: DataFrame, trusted: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_phrases, n_own_phrases, score.

    The reference of a document is every other document, or of those the ones whose doc_id is in ``trusted``. With ``exact``,
    matches are the longest ones whatever their length, else up to DEPTH words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if trusted is None:
        rows = rows.withColumn("trusted", F.lit(True))
    else:
        marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("mark", F.lit(True))
        rows = rows.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("mark", F.lit(False)).alias("trusted"))
    # Every round brings answers back to the blocks, which stay where this puts them.
    blocks = placed(_states(rows), "block")
    sweep(spark)
    words, reference = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_reference"), F.lit(0))).first()
    buckets = max(1, ceil(words / BUCKET_RUNS))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                yield pa.RecordBatch.from_pylist(list(_asked(block, np.ones(block.n, np.uint8), np.ones(block.n, np.bool_), 2, buckets, exact and DEPTH == 2)), _arrow(_MESSAGE))

    def later(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(own: pa.Table, answers: pa.Table) -> pa.Table:
            block = _Block(own.to_pylist()[0])
            lengths, useful, follows = _advanced(block, answers.to_pylist(), k, buckets)
            if k == DEPTH:
                if exact:
                    return pa.Table.from_pylist([_deepened(block, lengths, useful, follows, k)], _arrow(_DEEP))
                return _scored(block.row, match_lengths(lengths, k), reference)
            return pa.Table.from_pylist(list(_asked(block, lengths, useful, k + 1, buckets, exact and k + 1 == DEPTH)), _arrow(_MESSAGE))

        return run

    asked = blocks.mapInArrow(first, _MESSAGE)
    for k in range(2, DEPTH + 1):
        answers = checkpointed(asked.groupBy(_place(buckets)).applyInArrow(_answered, _MESSAGE))
        del asked
        sweep(spark)
        schema = _MESSAGE if k < DEPTH else _DEEP if exact else _RESULT
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later(k), schema)
    return _descend(asked, reference, DEPTH) if exact else asked


def _place(buckets: int) -> Column:
    """Where a message goes; what only passes through is spread by its block."""
    return F.when(F.col("bucket") < 0, F.pmod(F.hash("block"), F.lit(buckets))).otherwise(F.col("bucket")).alias("place")


def _descend(blocks: DataFrame, reference: int, depth: int) -> DataFrame:
    """The results of blocks after round ``depth``, whose open places are followed to their longest matches."""
    spark = blocks.sparkSession
    blocks = placed(blocks, "block")
    sweep(spark)
    n_places, n_deep = (n or 0 for n in blocks.agg(F.sum("n_places"), F.sum("n_deep")).first())
    buckets = max(1, ceil(n_places / BUCKET_RUNS))
    # The rounds need little of a block, and most of their time would go into starting tasks.
    columns = ("block", "trusted", "n_places", "docs", "needy", "starts", "reach", "n_deep", "deep")
    searched = placed(blocks.select(*columns), "block", max(1, ceil(n_deep / PART_WORDS)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_places"]
                tasks = [np.arange(n), np.full(n, depth, np.int64), np.full(n, _OPEN, np.int64), _unpack(row["needy"], n, np.bool_)]
                yield pa.RecordBatch.from_pylist(_questions(row, tasks, np.full(n, depth), buckets, True), _arrow(_QUESTION))

    def later(whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(own: pa.Table, answers: pa.Table) -> pa.Table:
            row = own.to_pylist()[0]
            return pa.Table.from_pylist(_questions(row, *_descended(row, answers.to_pylist(), whole), buckets), _arrow(_QUESTION))

        return run

    def meeting(whole: bool) -> Callable[[pa.Table], pa.Table]:
        return lambda rows: _met(rows, whole)

    def last(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        found = next(a["keys"] for a in answers.to_pylist() if a["bucket"] == -2)
        return _scored(row, _longest(row, _unpack(found, row["n_places"], np.int32)), reference)

    asked, whole = searched.mapInArrow(first, _QUESTION), True
    while True:
        answers = checkpointed(asked.groupBy(_place(buckets)).applyInArrow(meeting(whole), _QUESTION))
        del asked
        sweep(spark)
        if answers.filter("bucket >= 0").isEmpty():
            return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, _RESULT)
        asked = searched.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later(whole), _QUESTION)
        whole = False
