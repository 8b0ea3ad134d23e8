"""A bounded memo for words of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Entries of a generation, and the longest word that is kept after its text.
ENTRIES, LONGEST = 400_000, 64


class WordMemo:
    """Remembers what ``make`` gave for words, in two generations: words in use outlive the others.

    When the young generation is full it becomes the old one, whose words move over as they recur.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], entries: int = ENTRIES) -> None:
        self.make, self.entries = make, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def join(self, words: list[str]) -> bytes:
        """What ``make`` gives for each word, joined."""
        got = list(map(self.young.get, words))
        if None in got:
            new = {w for w, v in zip(words, got, strict=True) if v is None}
            if len(self.young) + len(new) > self.entries:
                self.old, self.young = self.young, {}
            known = {w: v for w in new if (v := self.old.get(w)) is not None}
            missing = [w for w in new if w not in known]
            if missing:
                known.update(zip(missing, self.make(missing), strict=True))
            got = [known[w] if v is None else v for w, v in zip(words, got, strict=True)]
            self.young.update((w, v) for w, v in known.items() if len(w) <= LONGEST)
        return b"".join(got)
