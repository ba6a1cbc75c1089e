"""Plain versions of the operators, for small tables: lists and loops, no Spark."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import ceil, floor, log

import xxhash
from tokenizers import Tokenizer

from gaugeworks.llm import encoding


def draw(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def token_lengths(texts) -> list[int]:
    tokenizer = Tokenizer.from_file(encoding.default_tokenizer())
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


# --- packing


def best_fit(lengths, sources, clusters, capacity, limit):
    """Every bin is looked at for every piece; None conflicts with nothing."""
    bins: list[list[int]] = []
    out = []
    for i, need in enumerate(lengths):
        best = None
        for b, held in enumerate(bins):
            free = capacity - sum(lengths[j] for j in held)
            same_source = sum(sources[j] == sources[i] and sources[i] is not None for j in held)
            same_cluster = any(clusters[j] == clusters[i] and clusters[i] is not None for j in held)
            if 0 < free >= need and same_source < limit and not same_cluster and (best is None or free < best[0]):
                best = (free, b)
        if best is None:
            bins.append([])
            best = (capacity, len(bins) - 1)
        out.append((best[1], capacity - best[0]))
        bins[best[1]].append(i)
    return out


def pack(rows, capacity=2048, limit=4):
    """(bin, offset, doc_id, source, cluster, piece, piece_start, n_tokens) for one shard of (doc_id, source, cluster, n_tokens)."""
    by_id = sorted(rows, key=lambda r: (-r[3], r[0], r[2]))
    whole, rest = [], []
    for i, s, c, n in by_id:
        for piece in range(n // capacity):
            whole.append((len(whole), 0, i, s, c, piece, piece * capacity, capacity))
        if n % capacity or n == 0:
            rest.append((i, s, c, n // capacity, n % capacity))
    rest.sort(key=lambda r: -r[4])
    found = best_fit([r[4] for r in rest], [r[1] for r in rest], [r[2] for r in rest], capacity, limit)
    return whole + [(len(whole) + b, at, i, s, c, p, p * capacity, n) for (b, at), (i, s, c, p, n) in zip(found, rest, strict=True)]


# --- quality


def gram_buckets(text):
    """Lower-cased words and neighbouring pairs, hashed to 16 bits."""
    ones = [xxhash.xxh64_intdigest(w.encode()) for w in (text or "").lower().split()]
    twos = [(a * 0x9E3779B97F4A7C15 + b) % (1 << 64) for a, b in zip(ones, ones[1:])]
    return [x % 65536 for x in ones] + [(x ^ (x >> 29)) % 65536 for x in twos]


def quality_kept(docs, labels, k=None):
    """log weight and score of every (doc_id, text), and the kept doc_ids."""
    worst = {}
    for i, q, toxic in labels:
        if i is not None and q is not None:
            old = worst.get(i, (1, 0))
            worst[i] = (min(old[0], q), max(old[1], toxic or 0))
    good = {i for i, (q, toxic) in worst.items() if q == 1 and not toxic}
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(gram_buckets(t))
        if i in good:
            target.update(gram_buckets(t))
    n_raw, n_target = raw.total(), target.total()
    more = max(0.5 * n_target / 65536, 1.0)
    weight = {}
    for i, t in docs:
        grams = gram_buckets(t)
        total = sum(log((target[g] + more) / (raw[g] * n_target / n_raw + more)) for g in grams) if n_target else 0.0
        weight[i, t] = 200 * total / (len(grams) + 100) if grams else 0.0
    score = {(i, t): w + gumbel(i) for (i, t), w in weight.items()}
    if k is None:
        n_good = sum(q == 1 for q, _ in worst.values())
        share = n_good / len(worst) if 0 < n_good < len(worst) else 1.0
        k = ceil(len(docs) * (share + 0.05 * (1 - share)))
    cut = sorted((score[d] for d in docs), reverse=True)[k - 1] if 0 < k <= len(docs) else float("-inf")
    return weight, score, {d for d in docs if score[d] >= cut}


def xxh64_chain(text: str) -> int:
    """Spark's xxhash64(text, 2): the text's hash seeds that of the int."""
    first = xxhash.xxh64_intdigest(text.encode(), 42)
    return xxh64_int(2, first)


def xxh64_int(value: int, seed: int) -> int:
    """XXH64 of four octets."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def gumbel(doc_id, seed=6) -> float:
    u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:8], 16)
    return -log(-log((u + 0.5) / 4294967296.0))


# --- copies


def exact_kept(docs):
    """Of equal squeezed texts the longest, then the smallest doc_id."""
    groups = defaultdict(list)
    for d in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")].append(d)
    return [min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values()]


def simhash(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_kept(docs, bits=4):
    """One document, that of the smallest id, of every component."""
    prints = [simhash(d[1]) for d in docs]
    left, kept = set(range(len(docs))), []
    while left:
        todo = [left.pop()]
        group = []
        while todo:
            i = todo.pop()
            group.append(i)
            close = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= bits}
            left -= close
            todo += close
        kept.append(min((docs[i] for i in group), key=lambda d: d[0]))
    return kept


# --- mixing


def schedule(rows, max_repeats=1.25, seed=1):
    """(doc_id, epoch) of every reading, for rows of (doc_id, source, n_tokens)."""
    totals = Counter()
    for _, s, n in rows:
        totals[s] += n
    total = budget = sum(totals.values())
    share = {s: n / total for s, n in totals.items()}
    repeats = lambda a: max(p ** (a - 1) for p in share.values()) / sum(p**a for p in share.values())
    lo, hi = 0.0, 1.0
    if repeats(0.0) <= max_repeats + 1e-12:
        hi = 0.0
    else:
        for _ in range(45):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if repeats(mid) <= max_repeats + 1e-12 else (mid, hi)
    exponent = round(hi, 6)
    norm = sum(p**exponent for p in share.values())
    out = []
    for s, p in share.items():
        part = floor(p**exponent / norm * budget)
        for epoch in range(ceil(part / totals[s])):
            before = epoch * totals[s]
            for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (draw(seed, epoch, r[0]), r[0])):
                if before < part:
                    out.append((i, epoch))
                before += n
    return out
