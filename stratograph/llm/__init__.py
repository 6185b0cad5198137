"""Training-data operators: near-duplicates, repeats, mixing, sharding, tokens and chat.

Nothing outside this folder imports it; it imports nothing of the rest of the library.
"""
