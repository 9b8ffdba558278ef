"""Hashes of the words and word windows of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: The lowest i bytes of a number.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: A-Z become a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words ([^\\x20\\x09-\\x0D]+) of all texts in order, the text of each, and its line (\\n-split) in that text."""
    raw = [t if isinstance(t, bytes) else t.encode() if t else b"" for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    buf = b"\n".join(raw) + b"\n" * 16
    if lower:
        buf = buf.translate(LOWER)
    b = np.frombuffer(buf, dtype=np.uint8)
    word = ~_SPACE[b]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if word[0]:
        first = np.concatenate(([0], first))
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    size = end - first
    # Words are hashed eight bytes at a time; few are longer.
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = mix((eight[first] & _LOWEST[np.minimum(size, 8)]) * _P + size.astype(np.uint64))
    left, done = np.flatnonzero(size > 8), 8
    while len(left):
        h[left] = mix(h[left] * _Q + (eight[first[left] + done] & _LOWEST[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    doc = np.searchsorted(starts, first, side="right") - 1
    newlines = np.flatnonzero(b == 10)
    line = np.searchsorted(newlines, first) - np.searchsorted(newlines, starts)[doc]
    return h, doc, line


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the text of each; a text of fewer words (but some) gives one, of all its words."""
    n = np.bincount(doc, minlength=n_docs)
    at = np.cumsum(n) - n
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        m = len(words) - k + 1
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = (h + words[i : i + m]) * _Q
        whole = doc[:m] == doc[k - 1 :]
        h, d = mix(h[whole]), doc[:m][whole]
    brief = np.flatnonzero((n > 0) & (n < k))
    if len(brief):
        extra = []
        for i in brief:
            x = np.uint64(n[i])
            with np.errstate(over="ignore"):
                for w in words[at[i] : at[i] + n[i]]:
                    x = (x + w) * _P
            extra.append(x)
        h, d = np.concatenate((h, mix(np.array(extra, np.uint64)))), np.concatenate((d, brief))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def chunks(texts: list, size: int = 1 << 18):
    """Ranges of texts of about size characters each (at least one text)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
