"""A bounded cache from words to encoded ids, kept by a Python worker between tasks."""

from __future__ import annotations

from collections.abc import Callable

#: Entries, and letters and bytes in them, before the cache starts anew.
MAX_WORDS, MAX_SIZE = 400_000, 32 << 20


class WordCache(dict):
    """Maps a word to the bytes of its ids. ``encode_words`` gives the bytes of a list of new words."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], limit: int = MAX_WORDS):
        super().__init__()
        self.encode_words, self.limit, self.size = encode_words, limit, 0

    def learn(self, docs: list[list[str]]) -> None:
        """Encode the words of ``docs`` that are missing, all at once."""
        if len(self) > self.limit or self.size > MAX_SIZE:
            self.clear()
            self.size = 0
        new: set[str] = set().union(*docs)
        new.difference_update(self)
        if new:
            words = sorted(new)
            ids = self.encode_words(words)
            self.size += sum(map(len, words)) + sum(map(len, ids))
            self.update(zip(words, ids, strict=True))

    def join(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))
