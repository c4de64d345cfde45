"""Burrows-Wheeler transforms of shards of text, and their merge by refining an interleave.

The symbols of these transforms are WIDTH bytes long, so that a refinement goes WIDTH bytes further.
"""

from __future__ import annotations

import numpy as np

WIDTH = 8
#: Bytes that UTF-8 never has: what stands after each text, and after the last.
_END, _LAST = b"\xfe", b"\xff" * WIDTH


def _heads(data: np.ndarray) -> np.ndarray:
    """The WIDTH bytes from each place on, around the end, as numbers that sort like them."""
    around = np.concatenate([data, data[:WIDTH]]).astype(np.uint64)
    head = np.zeros(len(data), np.uint64)
    for j in range(WIDTH):
        head = head << np.uint64(8) | around[j : j + len(data)]
    return head


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of runs, from flags of where one starts."""
    starts = np.flatnonzero(change)
    return starts, np.diff(np.append(starts, len(change)))


def _changes(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]])


class Shard:
    """The transform of some texts: ``transform`` has the WIDTH bytes before each suffix, in the suffixes' order.

    ``order`` has the suffixes' places in the shard, ``place`` is its inverse; ``group`` numbers, by
    place in the shard, suffixes with the same first *depth* bytes.  Suffixes are sorted by doubling; those that stand alone
    already are not sorted again.
    """

    def __init__(self, texts: list[bytes], depth: int):
        data = np.frombuffer(_END.join(texts) + _END + _LAST, np.uint8)
        n = len(data)
        self.head = _heads(data)
        order = np.argsort(self.head, kind="stable")
        ordered = self.head[order]
        starts, sizes = _runs(_changes(ordered))
        block = np.empty(n, np.int64)
        block[order] = np.repeat(starts, sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        known, self.group = WIDTH, block.copy() if depth == WIDTH else None
        while len(tied):
            ahead = min(known, depth - known) if known < depth else known
            own = order[tied]
            keys = block[own] * n + block[(own + ahead) % n]
            # Blocks are runs of `order`, so a sort by (block, what is ahead) stays within them.
            by = np.argsort(keys, kind="stable")
            order[tied] = own = own[by]
            starts, sizes = _runs(_changes(keys[by]))
            block[own] = np.repeat(tied[starts], sizes)
            tied = tied[np.repeat(sizes > 1, sizes)]
            known += ahead
            if known == depth:
                self.group = block.copy()
        if self.group is None:
            self.group = block
        self.order = order
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.transform = self.head[order - WIDTH]


def merge(shards: list[Shard], wanted: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Of the strings of *depth* bytes that start at *wanted* places of each shard, those that another
    shard has too, as places.  A shard's wanted strings are different ones.

    The interleave starts from the strings' last bytes (what WIDTH leaves of *depth*), as the shards
    have them in order.  A round takes each suffix's symbol from its shard's transform and steps to the
    suffix that the symbol starts, sorting stably by symbol: then the interleave is in order by WIDTH more bytes,
    and a block of it, an interval of suffixes with that common prefix, falls apart where symbols differ.  A block of one shard
    only is settled and left out.  What is left after the last round are the repeated intervals.
    No suffixes are sorted; only the symbols are, once, to number them and to count where each step leads.
    """
    bases = np.cumsum([0, *(len(s.order) for s in shards)])
    symbols = np.concatenate([s.transform for s in shards])
    by = np.argsort(symbols, kind="stable")
    rank = np.empty(len(symbols), np.int64)
    rank[by] = np.cumsum(_changes(symbols[by])) - 1
    step = np.empty(len(symbols), np.int64)
    owner = np.searchsorted(bases, by, "right") - 1
    for k in range(len(shards)):
        step[by[owner == k]] = np.arange(bases[k], bases[k + 1])
    low, high = (rank & 0xFFFF).astype(np.uint16), (rank >> 16).astype(np.uint16)

    rest = depth % WIDTH
    at, heads, shard = [], [], []
    for k, (s, starts) in enumerate(zip(shards, wanted, strict=True)):
        place = np.sort(s.place[starts + depth - rest])
        at.append(place + bases[k])
        heads.append(s.head[s.order[place]] >> np.uint64(64 - 8 * rest) if rest else np.zeros(len(place), np.uint64))
        shard.append(np.full(len(place), k, np.int16))
    at, heads, shard = map(np.concatenate, (at, heads, shard))
    by = np.argsort(heads, kind="stable")
    at, shard, change = at[by], shard[by], _changes(heads[by]) if len(by) else np.empty(0, bool)
    block = np.cumsum(change)
    for _ in range(depth // WIDTH):
        if not len(at):
            break
        by = np.argsort(low[at], kind="stable")
        by = by[np.argsort(high[at[by]], kind="stable")]
        at, shard, block = at[by], shard[by], block[by]
        symbol = rank[at]
        starts, sizes = _runs(_changes(symbol) | _changes(block))
        # Within a block suffixes come by shard, as all sorting is stable.
        several = shard[starts] != shard[starts + sizes - 1]
        kept = np.repeat(several, sizes)
        at, shard = step[at[kept]], shard[kept]
        block = np.repeat(np.arange(int(several.sum())), sizes[several])
    return [s.order[at[shard == k] - bases[k]] for k, s in enumerate(shards)]


def repeated_starts(texts: list[bytes], owned: np.ndarray, counts: np.ndarray, depth: int, shards: int = 4) -> list[np.ndarray]:
    """For each text, which of its first *owned* places start a string of *depth* bytes found again.

    Each text has at least ``owned + depth - 1`` bytes; *counts* says how often it occurs.  Texts are
    dealt to *shards*; a string is found again where its shard has it twice (or in a text that occurs
    twice), or where the merge of the shards' transforms finds it in two.
    """
    parts = [range(k, len(texts), shards) for k in range(min(shards, len(texts)))]
    built, first_of, wanted, again = [], [], [], []
    for part in parts:
        own = [texts[i] for i in part]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
        first = np.cumsum(sizes) - sizes
        n = owned[part.start :: shards]
        # All starts in the shard, text by text.
        starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s = Shard(own, depth)
        _, least, group = np.unique(s.group[starts], return_index=True, return_inverse=True)
        times = np.bincount(group, np.repeat(counts[part.start :: shards], n))
        built.append(s)
        first_of.append((starts, least, group))
        wanted.append(starts[least])
        again.append(times > 1)
    for (starts, least, _), twice, found in zip(first_of, again, merge(built, wanted, depth), strict=True):
        twice |= np.isin(starts[least], found)
    out: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    for part, (_, _, group), twice in zip(parts, first_of, again, strict=True):
        cuts = np.cumsum(owned[part.start :: shards])[:-1]
        for i, flags in zip(part, np.split(twice[group], cuts), strict=True):
            out[i] = flags
    return out
