"""Operators for preparing training text: filtering, tokens, near copies, packing, chats, archives and search."""
