"""Plans made of several operators: experiments over splits and settings."""
