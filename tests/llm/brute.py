"""Slow versions of the operators, over lists of dicts."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa

from tarnwood.llm import mixing, packing, ppm_langid


def order(d):
    return (d["doc_id"] is None, d["doc_id"] or 0, d["key"])


def gone_lines(docs, min_chars=1):
    """{(doc_id, key): set of line numbers} that lie in a run, of any length, with ``min_chars`` visible characters that was seen before."""
    lines = {}
    for d in sorted(docs, key=order):
        if d["text"]:
            lines.setdefault((d["doc_id"], d["key"]), d["text"].split("\n"))
    gone, seen = {}, set()
    for name, own in lines.items():
        for p in range(len(own)):
            for h in range(1, len(own) - p + 1):
                run = tuple(own[p : p + h])
                if run in seen and len(re.sub(r"[ \t\n\x0b\f\r]", "", "".join(run))) >= min_chars:
                    gone.setdefault(name, set()).update(range(p, p + h))
                seen.add(run)
    return gone


def line_dedup(docs, min_chars=1):
    gone, out = gone_lines(docs, min_chars), []
    for d in docs:
        cut = gone.get((d["doc_id"], d["key"]), set())
        if d["text"] and cut:
            kept = [x for i, x in enumerate(d["text"].split("\n")) if i not in cut]
            if re.search(r"[^ \t\n\x0b\f\r]", "\n".join(kept)):
                out.append(d | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))})
        else:
            out.append(d)
    return out


def _bits(weights):
    """{hash: weight} folded bit by bit."""
    out = 0
    for b in range(64):
        if sum(np.float32(w) if h >> b & 1 else -np.float32(w) for h, w in sorted(weights.items())) > 0:
            out |= 1 << b
    return out


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _word_hash(w):
    """As a sum of powers over bytes."""
    h = sum((c + 1) * pow(0x100000001B3, i, 2**64) for i, c in enumerate(w))
    return _mix((h + len(w) * 0x9E3779B97F4A7C15) % 2**64)


def simhash(text):
    """(64 bits over words, 128 bits over runs of three words) by the definition; None without a word."""
    words = [_word_hash(w) for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+", (text or "").lower().encode())]
    if not words:
        return None
    count = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    runs = [_mix((a + b * 0x9E3779B97F4A7C15 + c * 0xC2B2AE3D27D4EB4F) % 2**64) for a, b, c in zip(words, words[1:], words[2:])] or words
    half = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return _bits({w: 1 + math.log(n) for w, n in count.items()}), half(runs) | half([_mix(h ^ 0x5851F42D4C957F2D) for h in runs]) << 64


def groups(docs, budget=8, sketch_bits=42):
    """{(doc_id, key): (doc_id, key) of the document that stays}, by all pairs."""
    named = {}
    for d in docs:
        named.setdefault((d["doc_id"], d["key"]), d)
    names = sorted(named, key=lambda n: order(named[n]))
    prints = [simhash(named[n]["text"]) for n in names]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if prints[i] and prints[j] and (prints[i][0] ^ prints[j][0]).bit_count() <= budget and (prints[i][1] ^ prints[j][1]).bit_count() <= sketch_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {names[i]: names[find(i)] for i in range(len(names))}


def near_dedup(docs):
    keep = groups(docs)
    return [d for d in docs if keep[d["doc_id"], d["key"]] == (d["doc_id"], d["key"])]


class SlowPPM:
    """Prediction by partial matching straight from counts, a byte at a time, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count = order, {}
        for t in texts:
            raw = t.lower().encode()
            for i, byte in enumerate(raw):
                for k in range(min(i, order) + 1):
                    own = self.count.setdefault(raw[i - k : i], {})
                    own[byte] = own.get(byte, 0) + 1
        held = lambda c: sum(self.count.get(c, {}).values()) >= 2
        self.known = {b""}
        for c in sorted(self.count, key=len):
            if c and held(c) and c[:-1] in self.known and c[1:] in self.known:
                self.known.add(c)

    def probability(self, context, byte):
        """The byte's own, or that of an escape and of what the shorter context leaves for the bytes not seen here."""
        seen = self.count.get(context, {})
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        below = (lambda x: 1 / 256) if not context else lambda x: self.probability(context[1:], x)
        if not seen:
            return below(byte)
        return kinds / (total + kinds) * below(byte) / (1 - sum(below(x) for x in seen))

    def bits(self, text):
        raw, total = text.lower().encode(), 0.0
        for i, byte in enumerate(raw):
            k = next(k for k in range(min(i, self.order), -1, -1) if raw[i - k : i] in self.known)
            total -= math.log2(self.probability(raw[i - k : i], byte))
        return total


def language_id(docs, model, slack=1.65, free=160.0):
    out = []
    for d in docs:
        text = (d["text"] or "").lower().encode()
        bits = np.zeros(len(model.languages))
        for i, tree in enumerate(model.trees):
            state = 0
            for byte in text:
                move = state * (tree.symbols + 1) + int(tree.classes[byte])
                bits[i] += tree.cost[move]
                state = tree.step[move]
        best = int(bits.argmin())
        if text and bits[best] <= slack * model.usual[best] * len(text) + free:
            out.append(d)
    return out


def mix(docs, block_docs=512, seed=7):
    """Each document as often as it is used."""
    count = lambda d: len(re.findall(r"\S+", d["text"] or "", re.ASCII))
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    sources = {}
    for d in docs:
        sources.setdefault(d["source"], []).append(d)
    tokens = {repr(s): sum(map(count, own)) for s, own in sources.items()}
    q = mixing.weights(tokens, mixing.solve_exponent(tokens))
    full = max([math.ceil(t / q[s]) for s, t in tokens.items() if t] or [0])
    out = []
    for s, own in sources.items():
        total, n_blocks = tokens[repr(s)], max(1, math.ceil(len(own) / block_docs))
        quota = math.floor(q[repr(s)] * full + 1e-6) if total else 0
        blocks = {}
        for d in own:
            h = md5(seed, "-" if d["doc_id"] is None else d["doc_id"])
            blocks.setdefault(int(h[:15], 16) % n_blocks, []).append((h, d["key"], d))
        for p in range(-(-quota // total) if total else 1):
            left = quota - p * total
            for b in sorted(blocks, key=lambda b: (md5(seed, "-" if s is None else s, b, p), b)):
                members = sorted(blocks[b], key=lambda x: x[:2])
                weight = sum(count(d) for _, _, d in members)
                if left > 0 or not total:
                    for h, k, d in members:
                        if left > sum(count(x) for a, c, x in members if (a, c) < (h, k)) or not weight:
                            out.append(d)
                left -= weight
    return out


def packing_cost(docs, window, split=64, truncate=512):
    """The least cost of one shard, by trying every cut."""
    row, tokens, _, kind = packing.units(pa.array([d["text"] for d in sorted(docs, key=order)], pa.string()), window)
    fine = np.array([0, split, truncate])[kind]
    best = [0.0] + [math.inf] * len(tokens)
    for j in range(1, len(tokens) + 1):
        used = 0
        for i in range(j - 1, -1, -1):
            used += int(tokens[i])
            if used > window:
                break
            best[j] = min(best[j], best[i] + window - used + (fine[j - 1] if j < len(tokens) else 0))
    return best[-1]


def passages(docs, length):
    """{(doc_id, key): set of word numbers} in a window of ``length`` words that another document has."""
    words = {(d["doc_id"], d["key"]): re.findall(rb"[^ \t\n\x0b\f\r]+", (d["text"] or "").encode()) for d in docs}
    where = {}
    for name, w in words.items():
        for p in range(len(w) - length + 1):
            where.setdefault(tuple(w[p : p + length]), set()).add(name)
    out = {}
    for name, w in words.items():
        for p in range(len(w) - length + 1):
            if len(where[tuple(w[p : p + length])]) > 1:
                out.setdefault(name, set()).update(range(p, p + length))
    return out


def trained(df):
    return ppm_langid.train(ppm_langid.training_rows(df, 160, 6_000), 4)
