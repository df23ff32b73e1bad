"""Byte-pair merges: which neighbours stay apart, decided from the ranks alone."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence


class Merges:
    """Ranks of a merge vocabulary over byte strings or over character strings.

    ``symbols`` splits a string into the smallest pieces. Any two neighbours whose
    concatenation has a rank can merge; lower ranks merge first, then those further left.
    """

    def __init__(self, ranks: dict[Hashable, int], symbols: Callable[[Hashable], Sequence]):
        self.ranks, self.symbols = ranks, symbols
        self._parts: dict = {}
        self.known: dict = {}

    def merge(self, piece) -> list:
        """The tokens of a piece by merging again and again (the definition; slow on long pieces)."""
        parts = list(self.symbols(piece))
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token) -> tuple | None:
        """The two parts that the last merge of a token joins; None for a token that merges never make."""
        if token not in self._parts:
            parts = list(self.symbols(token))
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._parts[token] = (parts[0], parts[-1] if len(parts) == 2 else None) if len(parts) < 3 and token in self.ranks or len(parts) == 1 else None
        return self._parts[token]

    def apart(self, left, right) -> bool:
        """Whether merging the two tokens' text gives just these two tokens.

        The merges inside both are undone from the last to the first. A merge across the
        border must at no time have come before the one that is undone next.
        """
        if not left:  # the start of a piece
            return self.halves(right) is not None
        key = (left, right)
        if key not in self.known:
            if len(self.known) > 500_000:  # a cache: emptying it costs time only
                self.known.clear()
            self.known[key] = self._stay(left, right)
        return self.known[key]

    def _stay(self, left, right) -> bool:
        ranks, none = self.ranks, 1 << 60
        undone = none  # rank of the earliest merge undone so far
        undone_left = False
        while True:
            across = ranks.get(left + right, none)
            # across the border is right of the left token's merges and left of the right token's
            if across < undone or across == undone != none and not undone_left:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None or b is None:
                return False
            rank_a = ranks[left] if a[1] is not None else -1
            rank_b = ranks[right] if b[1] is not None else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:  # of equal merges the right one came last
                undone, undone_left, left = rank_a, True, a[1]
            else:
                undone, undone_left, right = rank_b, False, b[0]
