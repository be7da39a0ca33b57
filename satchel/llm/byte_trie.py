"""Radix tries over byte strings, loaded from sorted keys, and their form as columns: the nodes in pre-order, children in byte order
(which is the order of code points), with the label of the edge to each node, its number of children and whether a key ends there.
What belongs to keys stands outside, in the order of keys, so that tries merge by their traversals."""

from __future__ import annotations

from collections.abc import Iterable


class Node:
    __slots__ = ("label", "kids", "ends")

    def __init__(self, label: bytes, ends: bool = False):
        self.label, self.kids, self.ends = label, [], ends


def load(keys: Iterable[bytes]) -> Node:
    """The root of the trie of keys that are sorted and different: each key leaves the path of the one before at their common
    prefix, where an edge is split if there is no node."""
    root = Node(b"")
    path, depths, before = [root], [0], b""
    for key in keys:
        same, most = 0, min(len(before), len(key))
        while same < most and before[same] == key[same]:
            same += 1
        below = None
        while depths[-1] > same:
            depths.pop()
            below = path.pop()
        if depths[-1] < same:
            cut = same - depths[-1]
            middle = Node(below.label[:cut])
            below.label = below.label[cut:]
            path[-1].kids[-1] = middle
            middle.kids.append(below)
            path.append(middle)
            depths.append(same)
        if same == len(key):  # the empty key
            path[-1].ends = True
        else:
            leaf = Node(key[same:], True)
            path[-1].kids.append(leaf)
            path.append(leaf)
            depths.append(len(key))
        before = key
    return root


def columns(root: Node) -> tuple[list[bytes], list[int], list[bool]]:
    """(labels, numbers of children, key ends here) of all nodes in pre-order."""
    labels, kids, ends, stack = [], [], [], [root]
    while stack:
        node = stack.pop()
        labels.append(node.label)
        kids.append(len(node.kids))
        ends.append(node.ends)
        if node.kids:
            stack += reversed(node.kids)
    return labels, kids, ends


def keys_of(labels: Iterable[bytes], kids: Iterable[int], ends: Iterable[bool]) -> list[bytes]:
    """The keys of a trie in order, or of several whose columns stand one after another."""
    out, paths, left = [], [], []
    for label, n, end in zip(labels, kids, ends):
        while left and not left[-1]:
            paths.pop()
            left.pop()
        if left:
            left[-1] -= 1
            label = paths[-1] + label
        if end:
            out.append(label)
        if n:
            paths.append(label)
            left.append(n)
    return out
