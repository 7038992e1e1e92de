"""All queries of this folder: importing the modules registers them."""

from . import chats, decontaminate, lexical, licenses, near_dup, packing, pii, quality, secrets, sharding, substrings, token_files, variants  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
