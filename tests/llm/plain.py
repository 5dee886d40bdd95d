"""Plain Python versions of the operators, for small inputs, and rows to run both on."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LICENSE = "Released under the MIT License."
# Cases that every operator has to get along with: null, empty, blank, short, repeated, very long.
TEXTS = [
    None,
    "",
    "  \t\n ",
    "one",
    "two words",
    "A line of some plain words that stands here.\nAnother line of words, number 12, that stands here.",
    "A line of some plain words that stands here.\nAnother line of words, number 77, that stands here.",
    "A line of some plain words that stands here.\nAnother line of words, number 77, that stands here.",
    f"{LICENSE}\nÉté à la plage, ñandú über alles!\n\n\n",
    "word " * 3000 + "end",
    " ".join(f"w{i}" for i in range(20_000)),
    "token = 'abcDEF123456+/xyz' and AKIA" + "ABCDEFGHIJ123456 deadbeefdeadbeef0 <|endoftext|> ### $$$ 漢字 ṍ0",
]


def rows(texts=TEXTS):
    """Rows of documents with a null id, a repeated row and columns whose names the operators use."""
    made = [(i, t, "en", f"s{i % 3}" if i % 4 else None, "x", i) for i, t in enumerate(texts)]
    return [*made, made[5], (None, "no id but words of its own", "en", "s1", "y", 0), (None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, rid string, size long"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text: str | None, size: int = 3) -> int:
    words = WORD.findall(lower(text))
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(n: int, linked, names) -> list:
    """For each of ``n`` items the smallest name in its component, nulls last."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r = find(i)
        known = [x for x in (least.get(r), names[i]) if x is not None]
        least[r] = min(known) if known else None
    return [least[find(i)] for i in range(n)]


def repeated_words(words: list[str], size: int = 8) -> int:
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(size)})


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed


ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """Start, number of kind, kind, end of what the three patterns find."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spans_text(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
