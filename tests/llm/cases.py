"""Small document tables with the awkward cases, and plain-Python counterparts of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, node long, score string, "
    "id string, size string, `key` string, v string, cell string, `_block` string, label string"
)


def documents(spark, rows):
    """``rows`` are ``(doc_id, text, source)``; further columns clash with names the operators use."""
    data = [
        (i, t, "en", s, len(t or ""), "x", 7, "y", "z", "1", "k", "v", "c", "b", "l") for i, t, s in rows
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Null, empty, blank, one-word, very long, repeated and tied texts; null and repeated ids."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "word", "b"), (4, long, "b"), (5, same, "a")]
    rows += [(6, same, "b"), (7, same, "c"), (7, same, "c"), (None, prose(rng, 20), "c"), (8, "ß" * 50_000, "c")]
    rows += [(10 + i, prose(rng, rng.randint(1, 90)), rng.choice("aab")) for i in range(40)]
    return rows


ASSIGN = r'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)'
SECRETS = (
    ("assign", ASSIGN, lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
)


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m.group())) <= 19 and luhn(_digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m.group())) <= 15),
)


def base_spans(text: str | None, kinds) -> list[tuple]:
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, keep) in enumerate(kinds) for m in re.finditer(pattern, text or "") if keep(m)
    ]
    return sorted(found)


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


_LOWER = str.maketrans({c: chr(c + 32) for c in (*range(65, 91), *(x for x in range(0xC0, 0xDF) if x != 0xD7))})


def shingles(text: str | None) -> Counter:
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_groups(texts: list[str | None], threshold: float) -> list[int]:
    """Index of the first text of each text's group, by all pairs that share a shingle."""
    sets = [shingles(t) for t in texts]
    size = [sum(s.values()) for s in sets]
    holders, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x, n in s.items():
            for j, m in holders[x]:
                common[j, i] += min(n, m)
            holders[x].append((i, n))
    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if n >= threshold * (size[i] + size[j] - n) - 1e-9:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]
