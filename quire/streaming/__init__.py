"""Streams: the same operators over files and edits as they arrive. An extension; batch and stream give the same rows."""
