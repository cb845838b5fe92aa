"""Deep-shallow sorting of byte strings: multikey quicksort, then blind tries for long common prefixes."""

from __future__ import annotations

SHALLOW = 64
STEP = 8


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


class _Branch:
    """A blind-trie node: strings below agree before ``at`` and differ there; -1 stands for the end."""

    __slots__ = ("at", "kids")

    def __init__(self, at: int, kids: dict):
        self.at, self.kids = at, kids


def _blind_trie_order(strings: list[bytes], ids: list[int]) -> list[int]:
    """``ids`` in the order of their strings. A descent looks at branching bytes only; one comparison corrects it."""
    root: _Branch | list[int] = [ids[0]]

    def byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    for i in ids[1:]:
        s, node = strings[i], root
        while isinstance(node, _Branch):
            node = node.kids.get(byte(s, node.at)) or next(iter(node.kids.values()))
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.at < depth:
            above, node = node, node.kids[byte(s, node.at)]
        if isinstance(node, _Branch) and node.at == depth:
            node.kids[byte(s, depth)] = [i]
            continue
        fork = _Branch(depth, {byte(other, depth): node, byte(s, depth): [i]})
        if above is None:
            root = fork
        else:
            above.kids[byte(s, above.at)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack.extend(node.kids[k] for k in sorted(node.kids, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Indexes of ``strings`` in sorted order.

    Three-way quicksort on ``STEP`` bytes at a time down to ``SHALLOW`` bytes; groups that still agree there are
    ordered by a blind trie.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) <= 1:
            out.extend(ids)
            continue
        if depth >= SHALLOW:
            out.extend(_blind_trie_order(strings, ids))
            continue
        end = depth + STEP
        pivot = strings[ids[len(ids) // 2]][depth:end]
        less, same, more = [], [], []
        for i in ids:
            chunk = strings[i][depth:end]
            (same if chunk == pivot else less if chunk < pivot else more).append(i)
        stack.append((more, depth))
        if len(pivot) < STEP:  # the strings end here: all equal
            stack.extend(([i], depth) for i in reversed(same))
        else:
            stack.append((same, end))
        stack.append((less, depth))
    return out
