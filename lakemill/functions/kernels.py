"""Text kernels over Arrow arrays: signals of quality, languages, personal data and hashes of n-grams, for a chunk of texts at once."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CHUNK_BYTES = 1 << 20
_U = np.uint64


def chunked(texts: pa.Array, fn: Callable[[pa.Array], object]) -> Iterator[object]:
    """``fn`` of slices of about CHUNK_BYTES, one text at least, so that its arrays stay in the cache."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield fn(texts.slice(a, b - a))


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins; null counts as empty."""
    large = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    size = pc.utf8_length(large).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    off = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    raw = large.buffers()[2].to_pybytes()[off[0] : off[-1]] if large.buffers()[2] is not None else b""
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), first


ALPHA, DIGIT, SPACE, WORD = 1, 2, 4, 8


@functools.cache
def classes() -> np.ndarray:
    """ALPHA for alphabetic code points, DIGIT for ASCII digits, SPACE for white space, WORD for what a search takes as part of a word."""
    out = np.zeros(0x110000, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    for bit, pattern in ((ALPHA, r"\p{Alphabetic}+"), (SPACE, r"\p{White_Space}+"), (WORD, r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]+")):
        for m in regex.finditer(pattern, whole):
            out[at[m.start() : m.end()]] |= bit
    out[48:58] |= DIGIT
    return out


@functools.cache
def lower() -> np.ndarray:
    """The small letter of every code point, where it is one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x1F000)]:
        x = chr(c).lower()
        if len(x) == 1:
            out[c] = ord(x)
    return out


def runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and per-text first index of the maximal runs of True that don't cross texts."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    start = inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])) if n else inside
    stop = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])) if n else inside
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, first)


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, CHUNK_BYTES + 1), base, _U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def slices(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the slices [s, e) of a sequence of numbers, by prefix sums."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=total[1:])
    return mixed((total[e] - total[s]) * down[s] + (e - s).astype(_U))


def _sums(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[first])


def _counts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every text the number of distinct hashes, and how often the most frequent one occurs."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    # the text counts by a factor: hashes of single characters are mixed small numbers, as are those of texts, and a sum or XOR of the two is the same the other way round
    order = np.argsort(mixed(hashes + mixed(text.astype(_U) + _U(77)) * _U(0xD1342543DE82EF95)))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[at], np.diff(np.append(at, len(h))))
    return np.bincount(t[at], minlength=n), top


def _word_hash(word: str) -> int:
    codes = np.array([ord(c) for c in word], np.uint32)
    return int(slices(codes, np.array([0]), np.array([len(codes)]))[0])


# quality

STOPWORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "this", "but", "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their",
)
SIGNALS = {
    "char_count": pa.int64(), "word_count": pa.int64(), "mean_word_len": pa.float64(), "alpha_ratio": pa.float64(), "digit_ratio": pa.float64(), "symbol_ratio": pa.float64(),
    "alpha_word_ratio": pa.float64(), "dup_line_ratio": pa.float64(), "hash_line_ratio": pa.float64(), "top_word_ratio": pa.float64(), "stopword_ratio": pa.float64(), "dup_ngram_ratio": pa.float64(),
}


@functools.cache
def _stops() -> np.ndarray:
    return np.sort(np.array([_word_hash(w) for w in STOPWORDS], _U))


def signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """Twelve signals per text; ratios are of all characters, words, lines or word trigrams, 0 where there are none."""
    codes, first = points(texts)
    kind = classes()[codes]
    n, chars = len(first) - 1, np.diff(first)
    alpha, space = (kind & ALPHA) > 0, (kind & SPACE) > 0
    digit = ((kind & DIGIT) > 0) & ~alpha
    s, e, wfirst = runs(~space, first)
    words, length = np.diff(wfirst), e - s
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=whole > 0)
    hashes = slices(codes, s, e)
    _, top = _counts(hashes, wfirst)
    small = np.isin(slices(lower()[codes], s, e), _stops()) if len(s) else np.zeros(0, bool)
    letters = np.concatenate([[0], np.cumsum(alpha)])
    grams = np.maximum(words - 2, 0)
    gfirst = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(gfirst[-1]) + np.repeat(wfirst[:-1] - gfirst[:-1], grams)
    three = mixed(mixed(mixed(hashes[at]) + hashes[at + 1]) + hashes[at + 2]) if len(at) else np.zeros(0, _U)
    # lines end at line breaks, the last one at the end unless a break stands there; compared without white space around them
    ends = codes == 10
    lines = _sums(ends, first)
    closed = np.zeros(n, bool)
    closed[chars > 0] = ends[first[1:][chars > 0] - 1]
    lines = lines + ((chars > 0) & ~closed)
    before = np.concatenate([[0], np.cumsum(ends)])
    lfirst = np.concatenate([[0], np.cumsum(lines)])
    owner = np.repeat(np.arange(n), words)
    line = lfirst[owner] + before[s] - before[first[owner]]  # of every word
    new = np.ones(len(s), bool)
    new[1:] = line[1:] != line[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(s)) - 1 if len(head) else head
    trimmed = np.zeros(int(lfirst[-1]), _U)
    trimmed[line[head]] = slices(codes, s[head], e[last])
    marked = np.zeros(int(lfirst[-1]), bool)
    marked[line[head]] = codes[s[head]] == 35
    distinct, _ = _counts(trimmed, lfirst)
    gdistinct, _ = _counts(three, gfirst)
    return {
        "char_count": chars, "word_count": words, "mean_word_len": share(np.diff(np.concatenate([[0], np.cumsum(length)])[wfirst]), words),
        "alpha_ratio": share(_sums(alpha, first), chars), "digit_ratio": share(_sums(digit, first), chars), "symbol_ratio": share(_sums(~alpha & ~digit & ~space, first), chars),
        "alpha_word_ratio": share(_sums(letters[e] > letters[s], wfirst), words), "dup_line_ratio": share(lines - distinct, lines), "hash_line_ratio": share(_sums(marked, lfirst), lines),
        "top_word_ratio": share(top, words), "stopword_ratio": share(_sums(small, wfirst), words), "dup_ngram_ratio": share(grams - gdistinct, grams),
    }


#: Rules in the order in which they apply: the limit's name and default, the signal, whether it is a least, and how a rejection reads.
RULES = (
    ("min_words", 50, "word_count", True, "too_few_words:{x}<{limit}"), ("max_words", 100_000, "word_count", False, "too_many_words:{x}>{limit}"),
    ("min_mean_word_len", 3.0, "mean_word_len", True, "mean_word_len_low:{x:.2f}"), ("max_mean_word_len", 10.0, "mean_word_len", False, "mean_word_len_high:{x:.2f}"),
    ("max_symbol_ratio", 0.30, "symbol_ratio", False, "symbol_ratio_high:{x:.2f}"), ("min_alpha_word_ratio", 0.60, "alpha_word_ratio", True, "alpha_word_ratio_low:{x:.2f}"),
    ("max_dup_line_ratio", 0.30, "dup_line_ratio", False, "dup_line_ratio_high:{x:.2f}"), ("max_top_word_ratio", 0.30, "top_word_ratio", False, "top_word_ratio_high:{x:.2f}"),
    ("max_digit_ratio", 0.30, "digit_ratio", False, "digit_ratio_high:{x:.2f}"), ("min_stopword_ratio", 0.06, "stopword_ratio", True, "stopword_ratio_low:{x:.3f}"),
    ("max_dup_ngram_ratio", 0.30, "dup_ngram_ratio", False, "dup_ngram_ratio_high:{x:.2f}"),
)


def reasons(texts: pa.Array, limits: dict[str, float]) -> pa.Array:
    """The first rule that each text breaks, or null."""
    found = signals(texts)
    out: list[str | None] = [None] * len(texts)
    open_ = np.ones(len(texts), bool)
    for name, default, signal, least, shown in RULES:
        limit, x = limits.get(name, default), found[signal]
        bad = open_ & (x < limit if least else x > limit)
        for i in np.flatnonzero(bad).tolist():
            out[i] = shown.format(x=x[i], limit=limit)
        open_ &= ~bad
    return pa.array(out, pa.string())


# languages

SCRIPTS = {
    "zh": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)), "ja": ((0x3040, 0x30FF),), "ko": ((0xAC00, 0xD7AF),), "ru": ((0x400, 0x4FF),),
    "ar": ((0x600, 0x6FF),), "el": ((0x370, 0x3FF),), "hi": ((0x900, 0x97F),), "latin": ((65, 90), (97, 122)),
}
VOTES = {
    "en": "the and of to in is that it for was with as", "es": "el la de que y en los las una por con para", "fr": "le la de et les des un une que pour dans est",
    "de": "der die und das den von mit ist nicht ein eine auch", "it": "il di che la un per con non una sono gli", "pt": "de que os as um uma para com nao por dos das",
}
#: Words that a set names twice count twice for it.
_TWICE = {("it", "il")}


@functools.cache
def _scripts() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            out[a : b + 1] = i
    return out


@functools.cache
def _voters() -> tuple[np.ndarray, np.ndarray]:
    words = sorted({w for v in VOTES.values() for w in v.split()}, key=_word_hash)
    weight = np.array([[(w in v.split()) + ((k, w) in _TWICE) for k, v in VOTES.items()] for w in words], np.int64)
    return np.array([_word_hash(w) for w in words], _U), weight


def languages(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Language and confidence: the script of most letters; among Latin ones the vote of distinct stop words."""
    codes, first = points(texts)
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    script = _scripts()[codes]
    counts = np.bincount(text * 16 + script, minlength=n * 16).reshape(n, 16)[:, 1 : len(SCRIPTS) + 1]
    letters, best = counts.sum(axis=1), counts.argmax(axis=1)
    # words without what isn't alphabetic in them
    kind = classes()[codes]
    kept = (kind & (ALPHA | SPACE)) > 0
    place = np.concatenate([[0], np.cumsum(kept)])
    codes, kind, inner = lower()[codes[kept]], kind[kept], place[first]
    s, e, wfirst = runs((kind & SPACE) == 0, inner)
    known, weight = _voters()
    h = slices(codes, s, e)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h if len(h) else np.zeros(0, bool)
    both = np.unique(np.repeat(np.arange(n), np.diff(wfirst))[hit] * len(known) + at[hit])
    votes = np.zeros((n, len(VOTES)), np.int64)
    np.add.at(votes, both // len(known), weight[both % len(known)])
    total, most = votes.sum(axis=1), votes.max(axis=1, initial=0)
    names, scripts = list(VOTES), list(SCRIPTS)
    lang, conf = [], np.zeros(n)
    for i in range(n):
        if not letters[i]:
            lang.append("und")
        elif scripts[best[i]] != "latin":
            lang.append(scripts[best[i]])
            conf[i] = counts[i, best[i]] / letters[i]
        else:
            lang.append(names[int(votes[i].argmax())] if most[i] else "en")
            conf[i] = most[i] / total[i] if most[i] else 0.0
    return pa.array(lang, pa.string()), conf


# personal data

_START = regex.compile(r"@|https?://|[0-9]")
_DOMAIN, _URL, _DIGITS = regex.compile(r"[A-Za-z0-9.\-]*"), regex.compile(r"[^ \t\n\r\x0c]*"), regex.compile(r"[0-9.\-() ]*[0-9]|[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _number(token: str) -> str | None:
    groups = token.split(".")
    if len(groups) == 4 and all(g.isdigit() and int(g) < 256 for g in groups):
        return "ipv4"
    digits = "".join(c for c in token if c.isdigit())
    if 13 <= len(digits) <= 16 and _luhn(digits):
        return "credit_card"
    return "phone" if 10 <= len(digits) <= 12 else "ssn" if len(digits) == 9 else None


def personal(text: str) -> list[tuple[int, int, str]]:
    """(first character, end, kind) of e-mail addresses, URLs, IPv4 addresses, phone, social security and card numbers, as a scanner finds them."""
    out, at = [], 0
    while m := _START.search(text, at):
        i = m.start()
        at = i + 1
        if m[0] == "@":
            s, e = i, _DOMAIN.match(text, i + 1).end()
            while s and text[s - 1] in _LOCAL:
                s -= 1
            if s < i and e > i + 2 and "." in text[i + 1 : e]:
                out.append((s, e, "email"))
                at = e
        elif m[0][0] == "h":
            at = _URL.match(text, i).end()
            out.append((i, at, "url"))
        else:
            at = _DIGITS.match(text, i).end()
            if kind := _number(text[i:at]):
                out.append((i, at, kind))
    return out


def redacted(text: str) -> str:
    """The text with [EMAIL], [PHONE] and so on; of overlapping spans the first counts."""
    kept, at = [], 0
    for a, b, kind in sorted(personal(text), key=lambda x: x[0]):
        if a >= at:
            kept += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*kept, text[at:]]) if kept else text


# n-grams

_FNV, _PRIME64 = 0xCBF29CE484222325, 0x100000001B3
_ABREAST = 24


def folded(text: str) -> str:
    """Lower case, with one blank between words."""
    return " ".join(text.lower().split())


def sha256(texts: pa.Array, normalize: bool = True) -> pa.Array:
    fold = folded if normalize else (lambda t: t)
    return pa.array([None if t is None else hashlib.sha256(fold(t).encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def fnv(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """FNV-1a of byte slices side by side; the few longest go on one by one."""
    order = np.argsort(s - e, kind="stable")
    start, size = s[order], (e - s)[order]
    h = np.full(len(s), _FNV, _U)
    left = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left").tolist() if len(s) else []
    for k, n in enumerate(left):
        if n < _ABREAST:
            for i in range(n):
                x = int(h[i])
                for c in data[start[i] + k : start[i] + size[i]].tobytes():
                    x = (x ^ c) * _PRIME64 & 0xFFFFFFFFFFFFFFFF
                h[i] = x
            break
        h[:n] ^= data[start[:n] + k]
        h[:n] *= _U(_PRIME64)
    out = np.empty_like(h)
    out[order] = h
    return out


def gram_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of the word n-grams of every text in order, repeats among them, and each text's offset; of a shorter text all its words are one."""
    whole = "\n".join(folded(t or "") for t in texts.to_pylist()).encode()
    data = np.frombuffer(whole, np.uint8)
    edges = np.flatnonzero(data == 10)
    first = np.concatenate([[0], edges + 1]) if len(texts) else np.zeros(0, np.int64)
    inside = (data != 32) & (data != 10)
    s, e, wfirst = runs(inside, np.append(first, len(data))) if len(texts) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    words = np.diff(wfirst)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    gfirst = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(gfirst[-1]) + np.repeat(wfirst[:-1] - gfirst[:-1], count)
    stop = np.minimum(at + n, np.repeat(wfirst[1:], count)) - 1
    return fnv(data, s[at], e[stop]), gfirst


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text's n-grams, ascending, and offsets."""
    h, first = gram_hashes(texts, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(first) - 1))]).astype(np.int64)


def quick_signatures(h: np.ndarray, first: np.ndarray, num_hashes: int, seed: int) -> np.ndarray:
    """Minima of num_hashes multiplications by odd numbers over mixed hashes; rows of zeros for texts without any."""
    r = np.random.default_rng(seed)
    x, some = mixed(h), np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, num_hashes), _U)
    for i, f in enumerate(r.integers(0, 1 << 63, num_hashes, np.uint64) * _U(2) + _U(1)):
        if len(some):
            out[some, i] = np.minimum.reduceat(x * f, first[some])
    return out


def term_counts(texts: pa.Array, terms: list[str]) -> np.ndarray:
    """A row per text: its words, and how often each term, a small word, is among them."""
    codes, first = points(texts)
    s, e, wfirst = runs((classes()[codes] & WORD) > 0, first)
    h = slices(lower()[codes], s, e)
    out = [np.diff(wfirst)]
    for t in terms:
        out.append(_sums(h == _U(_word_hash(t)), wfirst))
    return np.stack(out, axis=1)
