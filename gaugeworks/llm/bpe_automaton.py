"""A byte-pair tokenizer as a deterministic automaton over its own tokens.

The automaton starts as one state with a loop for each octet.  The merges are applied
to it one after the other, each by a gadget: for the merge of u and v, the states that
u leads to are left for a copy from which v is taken away, and from every state with an
arc u there is now an arc uv, to where v led.  What is left at the end accepts exactly
the token sequences that the merges produce, so each text has one accepted path.

All arcs of a token lead to one state, since they do at the start and the gadget keeps
it so.  Whether a state has the arc uv is settled when uv is made: it has it if it has
the arc u then.  Tokens are therefore numbered by a walk over the tree of left parts,
younger children first: taking v away from a copy takes away one range of numbers, v
and whatever is made later with v on its left.  A state is a sorted list of such ranges,
so the compiled tables are short and a transition is a look-up by bisection.

Encoding looks for the accepted path of a word, longest arcs first.  A prefix has one
accepted path, so no place of the word is entered twice and the work is linear in its
length.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np

from .encoding import octet_letters


def letter_octets() -> dict[str, int]:
    return {letter: x for x, letter in octet_letters().items()}


class NotSupported(ValueError):
    """The tokenizer file asks for something the automaton does not do."""


@dataclass(frozen=True)
class Merges:
    """What a byte-level tokenizer file says: octets of each id, and merges (left, right, result) in order."""

    labels: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]


def read_merges(path: str) -> Merges:
    """Reads a tokenizer file; raises ``NotSupported`` unless it is plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before, after = told["model"], told["pre_tokenizer"] or {}, told.get("decoder") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
    for what, wrong in (
        ("a model other than BPE", model["type"] != "BPE"),
        (f"model options {odd}", bool(odd)),
        ("a normaliser", told.get("normalizer") is not None),
        ("a pre-tokeniser other than byte-level with its own pattern", before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)),
        ("a decoder other than byte-level", after.get("type") != "ByteLevel"),
        ("added tokens that are not plain special tokens", any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"])),
    ):
        if wrong:
            raise NotSupported(f"{path} has {what}")
    octets = letter_octets()
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    labels = {i: bytes(octets[c] for c in token) for token, i in vocab.items() if token not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Merges(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


@dataclass(frozen=True)
class Automaton:
    """The compiled tables: ``arcs`` by label (a Latin-1 letter for each octet), ``number``, ``target`` and ``labels`` by id, ``starts`` and ``ends`` (the ranges taken away) by state."""

    arcs: dict[str, int]
    labels: list[bytes]
    number: list[int]
    target: list[int]
    starts: list[list[int]]
    ends: list[list[int]]
    longest: int
    special: dict[str, int]

    @cached_property
    def trie(self) -> ahocorasick.Automaton:
        """The labels by their first octets: how far a text goes on like one of them."""
        made = ahocorasick.Automaton()
        for octets, token in self.arcs.items():
            made.add_word(octets, token)
        return made

    def has_arc(self, state: int, token: int) -> bool:
        n = self.number[token]
        k = bisect_right(self.starts[state], n)
        return not k or n >= self.ends[state][k - 1]

    def path(self, word: bytes) -> list[int]:
        """The one accepted path of ``word``."""
        arcs, number, target, starts, ends, reach, longest, n = self.arcs, self.number, self.target, self.starts, self.ends, self.trie.longest_prefix, self.longest, len(word)
        octets = word.decode("latin-1")  # a letter for each octet
        token = arcs.get(octets)
        if token is not None:
            return [token]  # a token with an arc anywhere has one from the start
        found: list[int] = []
        places = [0]
        dead: set[int] = set()
        at = state = 0
        end = reach(octets[:longest])
        while at < n:
            while end > at:
                token = arcs.get(octets[at:end])
                if token is not None:
                    x = number[token]
                    k = bisect_right(starts[state], x)
                    if (not k or x >= ends[state][k - 1]) and end not in dead:
                        break
                end -= 1
            else:  # nothing leads on from here: back to the arc before, and a shorter one
                if not found:
                    raise ValueError(f"no path for {word[:40]!r}")
                dead.add(at)
                end = at - 1
                found.pop()
                places.pop()
                at = places[-1]
                state = target[found[-1]] if found else 0
                continue
            found.append(token)
            places.append(end)
            at, state = end, target[token]
            end = at + reach(octets[at : at + longest])
        return found

    def emit(self, path: Iterable[int]) -> bytes:
        """The labels of the arcs of a path."""
        return b"".join(map(self.labels.__getitem__, path))


def compile_merges(told: Merges) -> Automaton:
    """Applies the merges to the one-state automaton, gadget by gadget."""
    size = max(told.labels) + 1
    made_at = [-1] * size  # when a token got its arcs; octets have them from the start
    left = [-1] * size
    single = [i for i, label in told.labels.items() if len(label) == 1]
    if len(single) != 256:
        raise NotSupported(f"{len(single)} octets have a token, not 256")
    known = set(single)
    target = [0] * size
    copied_from, taken_away, copied_at = [-1], [-1], [-1]  # by state

    def open_between(u: int, v: int) -> bool:
        """Whether the state that u leads to has the arc v, as the gadgets so far left it."""
        state, parts = target[u], [v]
        while left[parts[-1]] >= 0:
            parts.append(left[parts[-1]])
        latest = {p: made_at[parts[k - 1]] if k else size for k, p in enumerate(parts)}
        while state > 0:
            gone = taken_away[state]
            if gone in latest and latest[gone] >= copied_at[state]:
                return False
            state = copied_from[state]
        return True

    for at, (u, v, uv) in enumerate(told.merges):
        if uv in known:
            raise NotSupported(f"two merges make token {uv}")
        if u not in known or v not in known or not open_between(u, v):
            continue  # earlier merges leave no u before a v
        old, behind = target[u], target[v]
        copied_from.append(old)
        taken_away.append(v)
        copied_at.append(at)
        target[u] = len(copied_from) - 1
        target[uv] = behind
        left[uv], made_at[uv] = u, at
        known.add(uv)

    # Numbers: a token, then those it is the left part of, the youngest first.
    children: dict[int, list[int]] = {}
    for token in sorted(known, key=lambda x: -made_at[x]):
        if left[token] >= 0:
            children.setdefault(left[token], []).append(token)
    number, behind_last, order = [-1] * size, [0] * size, 0
    for root in single:
        stack = [(root, False)]
        while stack:
            token, done = stack.pop()
            if done:
                behind_last[token] = order
                continue
            number[token] = order
            order += 1
            stack.append((token, True))
            stack += [(c, False) for c in reversed(children.get(token, ()))]

    ranges: list[tuple[np.ndarray, np.ndarray]] = []
    for parent, gone, at in zip(copied_from, taken_away, copied_at, strict=True):
        if parent < 0:
            own = (np.empty(0, np.int32), np.empty(0, np.int32))
        else:
            lo, hi = number[gone], number[gone] + 1
            for c in children.get(gone, ()):  # youngest first: those made with the copy (uu where u meets itself) or after it
                if made_at[c] < at:
                    break
                hi = behind_last[c]
            own = with_range(*ranges[parent], lo, hi)
        ranges.append(own)
    place = {state: k for k, state in enumerate(sorted({0, *(target[t] for t in known)}))}
    starts, ends = ([ranges[state][side].tolist() for state in place] for side in (0, 1))
    labels = [told.labels.get(i, b"") for i in range(max(size, *(i + 1 for i in told.special.values()), 0))]
    for content, i in told.special.items():
        labels[i] = content.encode()
    arcs = {told.labels[t].decode("latin-1"): t for t in known}
    return Automaton(arcs, labels, number, [place.get(target[t], 0) for t in range(size)], starts, ends, max(map(len, arcs)), told.special)


def with_range(starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint ranges with one more, joined with those it touches."""
    a = int(np.searchsorted(ends, lo))
    b = int(np.searchsorted(starts, hi, side="right"))
    if a < b:
        lo, hi = min(lo, int(starts[a])), max(hi, int(ends[b - 1]))
    one = np.array([lo], np.int32), np.array([hi], np.int32)
    return np.concatenate((starts[:a], one[0], starts[b:])), np.concatenate((ends[:a], one[1], ends[b:]))
