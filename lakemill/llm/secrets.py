"""Secret scans by a character convolutional network in numpy.

Candidates are runs of key characters with a digit, of upper-case letters, of both cases or with a known
prefix, and whatever stands after a name like password and a colon or equals sign. The network reads each
candidate with the characters around it: learnt character vectors and the part (before, candidate,
after) they belong to, a convolution, the maximum and the mean over places, and a logistic output.
It is trained on labelled findings that a seeded generator writes, keys and passwords of usual kinds
in context against numbers, checksums, identifiers, paths and words; part of them calibrates the
output to a probability, and the threshold is the highest that keeps RECALL of the held-out secrets.

Defined results: null and empty texts have no findings; of overlapping candidates the longest counts,
one longer than the network's window gets the highest score of windows over all of it. Repeated rows
have equal findings; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import functools
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lakemill.llm import kernel
from lakemill.llm.frames import by_chunk, with_text

BEFORE, INSIDE, AFTER, SHORTEST = 24, 64, 8, 14
LENGTH = BEFORE + INSIDE + AFTER
DIM, WIDTH, FILTERS = 12, 5, 32
RECALL, EXAMPLES, EPOCHS, SEED = 0.99, 6000, 6, 11
MASK = "[SECRET]"
NAMED = r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key(?:[_-]?id)?|auth|credential)s?[\"']?\s*(?:[:=]|=>)\s*[\"']?"
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghs_", b"xoxb-", b"sk-", b"sk_live_", b"sk_test_", b"rk_live_", b"AIza", b"eyJ")
_NAMED = regex.compile(NAMED + r"(?P<v>[^\s\"'`,;<>]{6,})")
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in string.ascii_letters + string.digits + "+/_-"]] = True


def candidates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and byte after the last of every candidate, places counted in the chunk, and its bytes."""
    data, off = kernel.buffers(texts)
    s, e, _ = kernel.runs(_KEY[data], off) if len(data) else (np.zeros(0, np.int64),) * 3
    long = e - s >= SHORTEST
    s, e = s[long], e[long]
    within = lambda lo, hi: (lambda t: t[e] - t[s])(np.concatenate([[0], np.cumsum((data >= lo) & (data <= hi))]))
    if len(s):
        digits, upper, lower = within(48, 57), within(65, 90), within(97, 122)
        ok = (digits >= 1) | (upper == e - s) & (e - s >= 16) | (upper >= 3) & (lower >= 3) & (e - s >= 20)
        for x in PREFIXES:  # a run is longer than any of them
            ok |= np.logical_and.reduce([data[s + i] == c for i, c in enumerate(x)])
        s, e = s[ok], e[ok]
    extra = []
    named = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, NAMED), False).to_numpy(zero_copy_only=False))
    for d in named.tolist():
        text = texts[d].as_py()
        byte = np.flatnonzero((data[off[d] : off[d + 1]] & 0xC0) != 0x80) + off[d]  # of every character
        for m in _NAMED.finditer(text):
            value = m["v"].rstrip(".!?)")
            if len(value) >= 6:
                a = int(byte[m.start("v")])
                extra.append((a, a + len(value.encode())))
    if extra:
        x = np.array(extra)
        s, e = np.concatenate([s, x[:, 0]]), np.concatenate([e, x[:, 1]])
        order = np.lexsort((-e, s))
        s, e = s[order], e[order]
        reach = np.maximum.accumulate(e)
        fresh = np.concatenate([[True], s[1:] >= reach[:-1]])
        head = np.flatnonzero(fresh)
        s, e = s[head], np.maximum.reduceat(e, head)
    return np.searchsorted(off, s, side="right") - 1, s, e, data


def windows(data: np.ndarray, off: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and parts of every window, and which candidate each is of; long candidates have several."""
    more = np.maximum(1, -(-(e - s - INSIDE) // (INSIDE // 2)) + 1)
    which = np.repeat(np.arange(len(s)), more)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more)
    a = s[which] + nth * (INSIDE // 2)
    b = np.minimum(a + INSIDE, e[which])
    lo, hi = off[doc[which]], off[doc[which] + 1]
    code, part = np.zeros((len(which), LENGTH), np.uint8), np.zeros((len(which), LENGTH), np.uint8)
    for i in range(LENGTH):
        if i < BEFORE:
            at, ok, kind = a - BEFORE + i, a - BEFORE + i >= lo, 1
        elif i < BEFORE + INSIDE:
            at, kind = a + i - BEFORE, 2
            ok = at < b
        else:
            at, kind = b + i - BEFORE - INSIDE, 3
            ok = at < hi
        x = data[np.clip(at, 0, len(data) - 1)]
        code[:, i] = np.where(ok, np.where(x < 127, np.maximum(x, 1), 127), 0)
        part[:, i] = np.where(ok, kind, 0)
    return code, part, which


@dataclass
class Network:
    """Weights; ``scale`` and ``shift`` calibrate the output, ``threshold`` decides."""

    vectors: np.ndarray
    parts: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, code: np.ndarray, part: np.ndarray):  # noqa: ANN201
        x = np.concatenate([self.vectors[code], self.parts[part]], axis=2)
        n, length, dim = x.shape
        patches = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * (length - WIDTH + 1), WIDTH * dim)
        z = (patches @ self.filters + self.bias).reshape(n, length - WIDTH + 1, FILTERS)
        h = np.maximum(z, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return pooled @ self.out + self.base, (patches, h, top, pooled)

    def score(self, code: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, some windows at a time."""
        parts = [self.forward(code[i : i + 512], part[i : i + 512])[0] for i in range(0, len(code), 512)]
        z = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))


def examples(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Labelled findings: texts in which the candidate stands between \\x01 and \\x02, and whether it is a secret."""
    r = np.random.default_rng(seed)
    pick = lambda a, k: "".join(r.choice(list(a), k))
    B36, HEX, B62 = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "er on an re he in ed nd ha at en es of or nt ea ti to it st ou ch de la que ción ung eau sch ber tz ier lich ver ge oi aux elle ment tre vi ñe ar ad rr bo le ing th sh wh ly ble tion ge zu ei".split()
    known = (
        "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend "
        "jahr zeit mensch haus welt leben frau arbeit stadt wasser recht freund straße schule gesellschaft verein grund wirtschaft zeichnung über unter haupt schiff fahrt steuer antwort ausgabe maison temps homme femme jour monde enfant ville pays chose eau heure moment exemple raison marché tiempo hombre mujer mundo casa ciudad trabajo pueblo nombre cuenta agua noche historia gobierno archive image report document release config source package update backup final draft version notes summary index"
    ).split()
    word = lambda: str(r.choice(known)) if r.random() < 0.4 else "".join(r.choice(syllables, r.integers(1, 5)))
    letters = lambda lo, hi: ("".join(r.choice(known if r.random() < 0.5 else syllables, 20)).encode("ascii", "ignore").decode())[: int(r.integers(lo, hi))]
    styles = [lambda x: x] * 4 + [lambda x: x.upper() + "!!", lambda x: x + r.choice(["###", "***", "%%%", "$$$", "&&&", "|"]), lambda x: x.capitalize() + r.choice([".", ",", ""]), lambda x: "\"" + x + "\""]

    def prose(k: int) -> str:
        style = r.choice(styles)
        return " ".join(style(word()) for _ in range(k))

    name = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "API_KEY", "access_key", "auth_token", "client_secret", "PASSWORD", "SECRET_KEY", "credentials"])
    equals = lambda: r.choice(["=", " = ", ": ", "=\"", " = \"", ": '", ":\"", "=>"])
    secret = [
        lambda: ("", r.choice(["AKIA", "ASIA"]) + pick(B36, 16)), lambda: ("aws_secret_access_key" + equals(), pick(B62 + "+/", 40)),
        lambda: (name() + equals(), pick(HEX, int(r.integers(14, 65)))), lambda: ("", r.choice(["ghp_", "gho_", "ghs_"]) + pick(B62, 36)),
        lambda: ("", "xoxb-" + pick(string.digits, 11) + "-" + pick(B62, 24)), lambda: ("", r.choice(["sk_live_", "sk_test_", "sk-", "rk_live_"]) + pick(B62, int(r.integers(24, 48)))),
        lambda: ("", "AIza" + pick(B62 + "_-", 35)), lambda: ("Bearer ", "eyJ" + pick(B62, 33)), lambda: (name() + equals(), pick(B62, int(r.integers(10, 40)))),
        lambda: (name() + equals(), pick(B62 + "!@#$%^&*", int(r.integers(8, 20)))), lambda: ("-----BEGIN RSA PRIVATE KEY-----\n", pick(B62 + "+/", 64)), lambda: ("", pick(B62 + "+/", 64)),
    ]
    plain = [
        lambda: ("", pick(string.digits, int(r.integers(3, 5))) + "-" + pick(string.digits, 4) + "-" + pick(string.digits, 6) + word()), lambda: (r.choice(["commit ", "md5 ", "sha1: ", "checksum ", "sha256 of it is ", "revision "]), pick(HEX, int(r.choice([32, 40, 64])))),
        lambda: (r.choice(["id ", "uuid ", "order ", "session no. ", ""]), "-".join(pick(HEX, k) for k in (8, 4, 4, 4, 12))), lambda: ("", "_".join(word() for _ in range(int(r.integers(3, 6)))) + "_" + pick(string.digits, 2)),
        lambda: ("https://" + word() + ".com/", word() + "/" + word() + "-" + word() + "-" + word() + "/" + pick(string.digits, 4)), lambda: ("", r.choice(["IMG", "DSC", "report", "scan"]) + "_20" + pick("012", 2) + "0" + pick("123456789", 1) + pick("12", 2) + "_" + pick(string.digits, 6)),
        lambda: ("", "".join(word().capitalize() for _ in range(int(r.integers(5, 9))))), lambda: (r.choice(["ISBN ", "tel. ", "+", "no. "]), "-".join(pick(string.digits, 3) for _ in range(5)) + "x"), lambda: ("", "/".join(word() for _ in range(5)) + "/v" + pick("123", 2)),
        lambda: (r.choice(["password: ", "token: ", "secret: ", "auth: "]), word() + word() + word()), lambda: (r.choice(["password=", "token=", "api_key="]), r.choice(["<your-key-here>", "changeme_here", "xxxxxxxxxxxx", "required", "os.environ", "getenv(KEY)", "${SECRET}", "********"])), lambda: ("", "".join(word() for _ in range(6)) + pick("123", 2)),
        lambda: ("", letters(16, 32).upper()), lambda: (r.choice(["card ", "account ", "no. ", "tel. ", "\"### ", "!! ", ". ", ", ", ""]), pick(string.digits, int(r.integers(14, 21)))),
        lambda: ("", r.choice(["_", "-"]).join([*(word() for _ in range(int(r.integers(2, 5)))), pick(string.digits, int(r.integers(1, 3))), word()])), lambda: ("", r.choice(["img", "IMG", "DSC", "file", "v", "log", "backup"]) + r.choice(["_", "-"]) + pick(string.digits, 8) + r.choice(["_", "-", "T"]) + pick(string.digits, int(r.integers(4, 7)))),
        lambda: ("", "-".join(letters(3, 9) for _ in range(int(r.integers(3, 5)))) + r.choice(["", "-2", "-19", "7"])), lambda: ("", letters(3, 6).upper() + letters(10, 20) + letters(4, 6).upper()),
    ]
    texts, y = [], np.zeros(n, np.int64)
    for i in range(n):
        y[i] = i % 2
        kinds = secret if y[i] else plain
        lead, body = kinds[int(r.integers(len(kinds)))]()
        end = "\"" if lead.endswith("\"") else "'" if lead.endswith("'") else ""
        texts.append(prose(int(r.integers(0, 6))) + r.choice([" ", " ", "\n"]) + lead + "\x01" + body + "\x02" + end + r.choice([" ", " ", ". ", "\n", ""]) + prose(int(r.integers(0, 4))))
    return texts, y


def arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each example."""
    raw = [t.encode() for t in texts]
    s = np.array([t.index(b"\x01") for t in raw])
    e = np.array([t.index(b"\x02") for t in raw]) - 1
    flat, off = kernel.buffers(pa.array([t.replace(b"\x01", b"").replace(b"\x02", b"").decode() for t in raw]))
    doc = np.arange(len(raw))
    code, part, which = windows(flat, off, doc, off[:-1] + s, off[:-1] + e)
    first = np.unique(which, return_index=True)[1]
    return code[first], part[first]


@functools.lru_cache(maxsize=2)
def train(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fits on four fifths of ``n`` generated findings; the rest calibrates and sets the threshold."""
    texts, y = examples(n, seed)
    code, part = arrays(texts)
    r = np.random.default_rng(seed)
    normal = lambda *shape, by: (r.normal(0, by, shape)).astype(np.float32)
    net = Network(normal(128, DIM, by=0.3), np.eye(4, dtype=np.float32), normal(WIDTH * (DIM + 4), FILTERS, by=0.15), np.zeros(FILTERS, np.float32), normal(2 * FILTERS, by=0.15))
    names = ("vectors", "filters", "bias", "out")
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    base = [0.0, 0.0]
    held = np.arange(n) % 10 >= 8
    rows, t = np.flatnonzero(~held), 0
    for _ in range(epochs):
        for batch in np.array_split(r.permutation(rows), max(1, len(rows) // 128)):
            t += 1
            c = code[batch]
            z, (patches, h, top, pooled) = net.forward(c, part[batch])
            g = ((1 / (1 + np.exp(-z)) - y[batch]) / len(batch)).astype(np.float32)
            wide = h.shape[1]
            gp = g[:, None] * net.out[None]
            gh = np.repeat(gp[:, None, FILTERS:] / wide, wide, axis=1)
            np.put_along_axis(gh, top[:, None], np.take_along_axis(gh, top[:, None], 1) + gp[:, None, :FILTERS], 1)
            gz = (gh * (h > 0)).reshape(-1, FILTERS)
            gx = np.zeros((len(batch), LENGTH, DIM + 4), np.float32)
            back = (gz @ net.filters.T).reshape(len(batch), wide, WIDTH, DIM + 4)
            for k in range(WIDTH):
                gx[:, k : k + wide] += back[:, :, k]
            gv = np.stack([np.bincount(c.ravel(), gx[..., d].ravel(), 128) for d in range(DIM)], axis=1).astype(np.float32)
            for k, d in (("vectors", gv), ("filters", patches.T @ gz), ("bias", gz.sum(0)), ("out", pooled.T @ g)):
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * d
                v *= 0.999
                v += 0.001 * d * d
                getattr(net, k)[...] -= 0.004 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
            base[0] = 0.9 * base[0] + 0.1 * float(g.sum())
            net.base -= 0.05 * base[0]
    z, truth = net.forward(code[held], part[held])[0].astype(float), y[held]
    for _ in range(200):  # Platt's scaling
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - truth) * z).sum() + 1e-2 * (net.scale - 1), (p - truth).sum()])
        curve = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, grad)
        net.scale, net.shift = net.scale - 0.5 * float(move[0]), net.shift - 0.5 * float(move[1])
    p = np.sort(1 / (1 + np.exp(-np.clip(net.scale * z[truth == 1] + net.shift, -50, 50))))
    net.threshold = min(float(p[int(len(p) * (1 - RECALL))]), 0.5)
    return net


def _found(texts: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, s, e, data = candidates(texts)
    off = kernel.buffers(texts)[1] if len(s) else np.zeros(1, np.int64)
    if not len(s):
        return doc, s, e, np.zeros(0), data, off
    code, part, which = windows(data, off, doc, s, e)
    p = np.zeros(len(s))
    np.maximum.at(p, which, net.score(code, part))
    ok = p >= net.threshold
    return doc[ok], s[ok], e[ok], p[ok], data, off


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, first_char, end_char, probability) of every finding; no shuffle."""
    net = train()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, s, e, p, data, off = _found(batch.column("text"), net)
        if not len(doc):
            return None
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters
        a, b = (before[x] - before[off[doc]] for x in (s, e))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(a), pa.array(b), pa.array(p)], ["doc_id", "first_char", "end_char", "probability"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, first_char bigint, end_char bigint, probability double")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every finding replaced by MASK, with all their columns; no shuffle."""
    net = train()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, s, e, _, data, off = _found(batch.column("text"), net)
        if not len(doc):
            return batch
        texts = batch.column("text").to_pylist()
        for d in np.unique(doc).tolist():
            kept, done = [], int(off[d])
            for a, b in zip(s[doc == d].tolist(), e[doc == d].tolist(), strict=True):
                kept += [data[done:a].tobytes().decode(), MASK]
                done = b
            texts[d] = "".join([*kept, data[done : off[d + 1]].tobytes().decode()])
        return with_text(batch, pa.array(texts, pa.string()))

    return by_chunk(docs, run, docs.schema)
