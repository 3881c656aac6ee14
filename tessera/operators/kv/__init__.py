"""Typed key spaces: strings, hashes, lists, sets and scored sets, with lazy expiry.

A read gives a DataFrame; a write gives the new key space with its reply. Nothing is changed in place.
"""

from tessera.operators.kv.base import KeySpace, Written
from tessera.operators.kv.commands import COMMANDS, run

__all__ = ["COMMANDS", "KeySpace", "Written", "run"]
