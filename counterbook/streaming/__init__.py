"""Streaming execution of the posting operators (see ``requests``)."""
