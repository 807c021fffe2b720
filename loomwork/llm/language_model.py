"""Document log-likelihood under a gated recurrent language model in numpy.

Token counts, their number and the vocabulary come from *all* training texts, by
a packed exchange; nothing of them is gathered but the `HEAD` commonest words and
a few sums.  The model's output is factored: a softmax
over classes, then, for head classes, a softmax over the class's words.  Rarer
words fall into tail classes by their last bytes; within one, a word w has

    (c(w) + 0.5) / (N_k + 0.5 * (V_k + 1))

with the count c(w) from all training texts, and the class's N_k tokens and V_k
words, so unseen words have a probability too.  The end of a text is a class of
its own.  The network is a GRU whose input is a table row per word or tail class.
It starts from the unigram counts, and is trained by truncated backpropagation
(state carried over windows of `STEPS` tokens) with Adam, on the executors, once over
every token of all training texts.  For that, texts become input numbers where they
are read, are dealt by a hash of id and text into shards (their number by the bytes of text alone), and shards into rounds; the
shards of a round start from the same weights, and the average of what they come to,
by tokens, starts the next round.  Shards a round and rounds both grow with the root
of the number of shards.  The driver holds weights only.

Scoring runs whole documents, batch by batch, all of a batch side by side; the
state is carried from window to window up to the end of each text.

Edge cases: null or blank text is the end token alone; a null doc_id is training
text; repeated rows are learnt from and scored each; a very long text is one lane's, to
its end; columns but doc_id and text are not read; without training text every count
is 0 and the network stays untrained; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common as C
from loomwork.llm import exchange as X
from loomwork.llm.toxicity import fold

HEAD = 1008
PER_CLASS = 32
TAILS = 24
HIDDEN = 32
STEPS = 20
WIDE = 256
ROUNDS = 8
RATE = 0.01
_COUNT = np.uint64((1 << 40) - 1)


def _words(text):
    for i, j, data, off in C.chunks(text):
        yield i, j, C.Words(C.lowered(data), off)


def _tails(w: C.Words) -> np.ndarray:
    """The tail class of each word, by its last two bytes."""
    if not len(w):
        return np.empty(0, np.uint64)
    last = w.data[w.end - 1].astype(np.uint64)
    near = w.data[np.maximum(w.end - 2, w.start)].astype(np.uint64)
    return C.mix(last * np.uint64(256) + near) % np.uint64(TAILS)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a batch, and of each: tail class << 40 | how often training texts have it."""
    train = np.array(table.column("train").to_pylist(), np.int64)
    keys, tail, count = [], [], []
    for i, j, w in _words(table.column("text")):
        keys.append(w.hash)
        tail.append(_tails(w))
        count.append(np.repeat(train[i:j], np.diff(w.first)))
    keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    if not len(keys):
        return keys, np.empty(0, np.uint64)
    uniq, inverse = C.distinct(keys)
    n, own = np.bincount(inverse, np.concatenate(count), len(uniq)).astype(np.uint64), np.empty(len(uniq), np.uint64)
    own[inverse] = np.concatenate(tail)
    return uniq, (own << np.uint64(40)) | n


def _sums(group: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    """The count over all batches; the first entry of each group is marked, so that words can be counted once."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, group, value & _COUNT)
    out = (value & ~_COUNT) | total[group]
    first = np.zeros(n, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    out[first] |= np.uint64(1) << np.uint64(63)
    return out


class Vocabulary:
    """Head words (sorted by hash), and the sums of tail classes."""

    def __init__(self, head: np.ndarray, head_count: np.ndarray, n_k: np.ndarray, v_k: np.ndarray, ends: int):
        order = np.argsort(head)
        self.head, self.count = head[order], head_count[order].astype(np.float64)
        self.ends = ends
        self.n_k, self.v_k = n_k.astype(np.float64), v_k.astype(np.float64)
        rank = np.argsort(np.argsort(-self.count, kind="stable"), kind="stable")
        self.of_head = rank // PER_CLASS
        self.n_head = max(1, -(-max(1, len(head)) // PER_CLASS))
        self.members = [np.flatnonzero(self.of_head == c) for c in range(self.n_head)]
        self.slot = np.zeros(len(head), np.int64)
        for m in self.members:
            self.slot[m] = np.arange(len(m))
        self.n_classes = self.n_head + TAILS + 1
        self.end = self.n_classes - 1
        self.n_inputs = len(head) + TAILS + 1
        self.class_of = np.concatenate((self.of_head, self.n_head + np.arange(TAILS), [self.end])).astype(np.uint16)

    def ids(self, w: C.Words) -> np.ndarray:
        """Input numbers of words: head words, then tail classes."""
        if not len(w):
            return np.empty(0, np.int64)
        out = len(self.head) + _tails(w).astype(np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, w.hash), len(self.head) - 1)
            hit = self.head[at] == w.hash
            out[hit] = at[hit]
        return out

    @property
    def stop(self) -> int:
        return len(self.head) + TAILS

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return self.class_of[ids]

    def first_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and word biases of the unigram model, 0 at the likeliest of each softmax."""
        mass = np.zeros(self.n_classes)
        np.add.at(mass, self.of_head, self.count)
        mass[self.n_head : self.end] = self.n_k
        mass[self.end] = self.ends
        word = np.full((self.n_head, PER_CLASS), -1e9)
        for c, m in enumerate(self.members):
            if len(m):
                word[c, : len(m)] = np.log((self.count[m] + 0.5) / (self.count[m].max() + 0.5))
        return np.log((mass + 0.5) / (mass.max() + 0.5)), word


def _tame(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether exp(h @ w + b) neither overflows nor vanishes whatever the state (its entries are within -1 and 1)."""
    reach = np.abs(w).sum(-2)
    return bool((b + reach).max() < 60 and (b - reach).max(-1).min() > -60)


def _exp(logit: np.ndarray, tame: bool) -> np.ndarray:
    """Row sums of exp(logit), which takes logit's place; where it might overflow, logits are first shifted."""
    if not tame:
        logit -= logit.max(1, keepdims=True)
    np.exp(logit, out=logit)
    return logit @ np.ones(logit.shape[1], logit.dtype)


class GRU:
    NAMES = ("inp", "rec", "out", "out_b", "word", "word_b")

    def __init__(self, vocab: Vocabulary, seed: int = 7, params: dict | None = None):
        self.v, h = vocab, HIDDEN
        if params is None:
            r = np.random.default_rng(seed)
            out_b, word_b = vocab.first_weights()
            params = {
                "inp": r.normal(0, 0.3, (vocab.n_inputs, 3 * h)), "rec": r.normal(0, 0.3, (h, 3 * h)),
                "out": r.normal(0, 0.05, (h, vocab.n_classes)), "out_b": out_b,
                "word": r.normal(0, 0.05, (vocab.n_head, h, PER_CLASS)), "word_b": word_b,
            }
            params["inp"][:, :h] += 1.0
        self.p = {k: x.astype(np.float32) for k, x in params.items()}

    def gates(self, name: str) -> np.ndarray:
        """A weight's three gates one after the other, so that each one's rows lie together."""
        return np.stack(np.split(self.p[name], 3, axis=1))

    def cell(self, g: np.ndarray, h: np.ndarray, rec: np.ndarray):
        """Inputs' rows g (gate x lane x unit; used up), state and rec's gates -> new state and what backpropagation needs."""
        r = np.matmul(h, rec)
        zr, c, rc = g[:2], g[2], r[2]
        zr += r[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, reset = zr
        c += reset * rc
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, (z, reset, c, rc)

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of y, their order, and where each head class begins in it."""
        cls = self.v.classes(y)
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.v.n_head + 1))

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """ln P of the class, and of head words within theirs; tail words' own share is not in it."""
        cls, order, cut = self._by_class(y)
        tame = _tame(self.p["out"], self.p["out_b"])
        logit = h @ self.p["out"]
        logit += self.p["out_b"]
        if not tame:
            logit -= logit.max(1, keepdims=True)
        out = logit[np.arange(len(y)), cls]
        out -= np.log(_exp(logit, True))
        order = order[: cut[-1]]
        h, slot, more = h[order], self.v.slot[y[order]], np.empty(cut[-1], h.dtype)
        tame = _tame(self.p["word"], self.p["word_b"])
        for c in range(self.v.n_head):
            a, b = cut[c], cut[c + 1]
            if b > a:
                word = h[a:b] @ self.p["word"][c]
                word += self.p["word_b"][c]
                if not tame:
                    word -= word.max(1, keepdims=True)
                more[a:b] = word[np.arange(b - a), slot[a:b]]
                more[a:b] -= np.log(_exp(word, True))
        out[order] += more
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray):
        """One window (steps x lanes) of truncated backpropagation: gradients, last state, loss."""
        n, (steps, lanes) = HIDDEN, x.shape
        saved, states, whole, rows = [], np.empty((steps, lanes, n), h.dtype), live.all(1), np.take(self.gates("inp"), x, axis=1)
        rec = self.gates("rec")
        for t in range(steps):
            if not whole[t]:
                h = h * live[t, :, None]
            new, keep = self.cell(rows[:, t], h, rec)
            saved.append((h, *keep))
            h = new
            states[t] = h
        flat, goal = states.reshape(-1, n), y.ravel()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        count = len(goal)
        cls, order, cut = self._by_class(goal)
        d = flat @ self.p["out"]
        d += self.p["out_b"]
        total = _exp(d, _tame(self.p["out"], self.p["out_b"]))
        d *= (1 / total)[:, None]
        loss = -np.log(d[np.arange(count), cls] + 1e-12).sum()
        d[np.arange(count), cls] -= 1
        d /= count
        g["out"], g["out_b"] = flat.T @ d, d.sum(0)
        dh_all = d @ self.p["out"].T
        order = order[: cut[-1]]
        heads, slot, dh_heads = flat[order], self.v.slot[goal[order]], np.empty((len(order), n), flat.dtype)
        tame = _tame(self.p["word"], self.p["word_b"])
        for c in range(self.v.n_head):
            a, b = cut[c], cut[c + 1]
            if b > a:
                d = heads[a:b] @ self.p["word"][c]
                d += self.p["word_b"][c]
                total = _exp(d, tame)
                d *= (1 / total)[:, None]
                at = np.arange(b - a), slot[a:b]
                loss -= np.log(d[at] + 1e-12).sum()
                d[at] -= 1
                d /= count
                g["word"][c], g["word_b"][c] = heads[a:b].T @ d, d.sum(0)
                dh_heads[a:b] = d @ self.p["word"][c].T
        dh_all[order] += dh_heads
        dh_all = dh_all.reshape(steps, lanes, n)
        carry, d_in = np.zeros((lanes, n), flat.dtype), np.empty((3, steps, lanes, n), flat.dtype)
        d_rec, before = np.empty_like(d_in), np.empty_like(states)
        back = np.ascontiguousarray(rec.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            prev, z, reset, c, rc = saved[t]
            dh = dh_all[t]
            dh += carry
            keep = 1 - z
            dc = d_in[2, t]
            np.multiply(dh, keep, out=dc)
            keep *= z
            keep *= prev - c
            np.multiply(dh, keep, out=d_in[0, t])
            np.multiply(c, c, out=c)
            np.subtract(1, c, out=c)
            dc *= c
            rc *= dc
            rc *= reset
            np.multiply(dc, reset, out=d_rec[2, t])
            np.subtract(1, reset, out=reset)
            np.multiply(rc, reset, out=d_in[1, t])
            d_rec[:2, t] = d_in[:2, t]
            before[t] = prev
            parts = np.matmul(d_rec[:, t], back)
            carry = dh * z
            for part in parts:
                carry += part
            if not whole[t]:
                carry *= live[t, :, None]
        g["rec"] = np.concatenate(np.matmul(before.reshape(-1, n).T, d_rec.reshape(3, -1, n)), axis=1)
        which = x.ravel().astype(np.uint16)
        order = np.argsort(which, kind="stable")
        which = which[order]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        g["inp"][which[first]] = np.concatenate(np.add.reduceat(np.take(d_in.reshape(3, -1, n), order, axis=1), first, axis=1), axis=1)
        return g, h, loss / count

    def train(self, total: np.ndarray, rate: float, lanes: int) -> list[float]:
        """total: input numbers of texts, each ended by vocab.stop.  Lanes read it side by side, once."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        before = np.concatenate(([self.v.stop], total[:-1]))
        starts = (np.arange(lanes) * len(total)) // lanes
        windows = math.ceil(math.ceil(len(total) / lanes) / STEPS)
        h, losses = np.zeros((lanes, HIDDEN), np.float32), []
        for i in range(windows):
            at = (starts[None, :] + i * STEPS + np.arange(STEPS)[:, None]) % len(total)
            x = before[at]
            g, h, loss = self.gradients(x, total[at], (x != self.v.stop).astype(np.float32), h)
            losses.append(float(loss))
            size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            step, fix = rate / (1 - 0.9 ** (i + 1)), 1 / (1 - 0.99 ** (i + 1))
            for k in self.NAMES:
                x = g[k]
                if size > 1:
                    x *= np.float32(1 / size)
                m[k] += np.float32(0.1) * (x - m[k])
                np.square(x, out=x)
                s[k] += np.float32(0.01) * (x - s[k])
                self.p[k] -= np.float32(step) * m[k] / (np.sqrt(s[k] * np.float32(fix)) + np.float32(1e-6))
        return losses

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """ln P of each text (input numbers without the end), but for the tail words' own shares."""
        size = np.array([len(t) + 1 for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([x for i in order for x in (texts[i], [self.v.stop])]).astype(np.int64)
        lead = np.cumsum(size[order]) - size[order]
        out, ends, t = np.zeros(len(texts)), size[order], 0
        inp, rec = self.gates("inp"), self.gates("rec")
        h, last = np.zeros((len(texts), HIDDEN), np.float32), int(ends[0])
        while t < last:
            n = int(np.searchsorted(-ends, -t, "left"))
            steps = min(last - t, max(1, min(512, 20_000 // n)))
            at = np.arange(t, t + steps)[:, None]
            live = at < ends[None, :n]
            goals = flat[lead[None, :n] + np.minimum(at, ends[None, :n] - 1)]
            before = np.concatenate((flat[lead[None, :n] + t - 1] if t else np.full((1, n), self.v.stop), goals[:-1]))
            rows, states, h = np.take(inp, before, axis=1), np.empty((steps, n, HIDDEN), np.float32), h[:n]
            for k in range(steps):
                h, _ = self.cell(rows[:, k], h, rec)
                states[k] = h
            got = self.log_probs(states[live], goals[live])
            out[:n] += np.bincount(np.nonzero(live)[1], got, n)
            t += steps
        back = np.empty(len(texts))
        back[order] = out
        return back


_SUMS = "shard int, n long, sums binary"


def _added(table: pa.Table) -> pa.Table:
    """The sum of shards' sums, in the shards' order."""
    order = np.argsort(table.column("shard").to_numpy(), kind="stable")
    cells = table.column("sums").to_pylist()
    total = sum(np.frombuffer(cells[i], np.float64) for i in order)
    return pa.table({"shard": pa.array([table.column("shard")[int(order[0])].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def n_shards(n_bytes: int) -> int:
    """Training shards of so many bytes of text: a function of the data alone, as the model depends on them."""
    unit = min(X.LARGEST, max(X.UNIT, int(X.UNIT * (n_bytes / (1 << 30)) ** 0.5)))
    return max(1, n_bytes // unit, min(16, n_bytes >> 20))


def learn_all(docs: DataFrame, to: X.Layout, model: GRU, about: tuple) -> int:
    """Trains model once over every token of docs (doc_id, text; training texts only); the number of tokens read."""
    spark = docs.sparkSession
    box = spark.sparkContext.broadcast(about)
    shards_ = n_shards(to.n_bytes)
    rounds = min(shards_, max(ROUNDS, math.isqrt(shards_)))
    shard = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.xxhash64("text")), F.lit(shards_)).cast("int")

    def encode(batches):
        vocab = Vocabulary(*box.value)
        for b in batches:
            for i, j, w in _words(b.column("text")):
                n = np.diff(w.first)
                ids = np.insert(vocab.ids(w), w.first[1:], vocab.stop).astype(np.uint16)
                ends = np.concatenate(([0], np.cumsum(2 * (n + 1)))).astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("shard").slice(i, j - i), cells], ["doc_id", "shard", "tokens"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        return pa.table({"shard": table.column("shard")[:1], "tokens": pa.array([b"".join(table.column("tokens").to_pylist())], pa.binary())})

    tokens = docs.select("doc_id", "text", shard.alias("shard")).mapInArrow(encode, "doc_id long, shard int, tokens binary")
    tokens = tokens.groupBy("shard").applyInArrow(packed, "shard int, tokens binary").withColumn("round", F.pmod("shard", F.lit(rounds)))
    shards = C.stored(tokens, "tokens", by="round")
    names, read = GRU.NAMES, 0
    for i in range(rounds):
        start = spark.sparkContext.broadcast(model.p)
        rate = RATE * (1 - 0.85 * i / rounds)

        def learn(batches, start=start, rate=rate):
            vocab = Vocabulary(*box.value)
            for b in batches:
                for shard, cell in zip(b.column("shard").to_pylist(), b.column("tokens"), strict=True):
                    ids = np.frombuffer(cell.as_py(), np.uint16).astype(np.int64)
                    if len(ids):
                        net = GRU(vocab, params={k: x.copy() for k, x in start.value.items()})
                        net.train(ids, rate, max(1, min(WIDE, len(ids) // (128 * STEPS))))
                        flat = np.concatenate([net.p[k].ravel() for k in names]).astype(np.float64) * len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "sums"])
            C.trim()

        width = max(1, math.ceil(shards_ / rounds))
        sums = shards.where(F.col("round") == i).select("shard", "tokens").repartitionByRange(width, "shard").mapInArrow(learn, _SUMS)
        if width > 64:
            sums = sums.groupBy(F.floor(F.col("shard") / (rounds * math.isqrt(width))).alias("lot")).applyInArrow(_added, _SUMS)
        got = sorted(sums.collect(), key=lambda r: r["shard"])
        n, whole = sum(r["n"] for r in got), sum(np.frombuffer(r["sums"], np.float64) for r in got)
        if n:
            mean, a = whole / n, 0
            for k in names:
                size, shape = model.p[k].size, model.p[k].shape
                model.p[k], a = mean[a : a + size].reshape(shape).astype(np.float32), a + size
        read += n
        start.unpersist()
    C.forget(shards)
    return read


def _scored(table: pa.Table, totals: np.ndarray, model: GRU) -> pa.Table:
    """Each text's tokens, known ones, base and score.  Everything a word adds is looked up once for each distinct word."""
    v = model.v
    spans = [(w.hash, w.first) for _, _, w in _words(table.column("text"))]
    hashes = np.concatenate([h for h, _ in spans]) if spans else np.empty(0, np.uint64)
    words, number = C.distinct(hashes)
    count, tail = (totals & _COUNT).astype(np.float64), ((totals >> np.uint64(40)) & np.uint64(127)).astype(np.int64)
    ids = len(v.head) + tail
    own = np.log((count + 0.5) / (v.n_k + 0.5 * (v.v_k + 1))[tail])
    if len(v.head) and len(words):
        at = np.minimum(np.searchsorted(v.head, words), len(v.head) - 1)
        hit = v.head[at] == words
        ids[hit], own[hit] = at[hit], 0.0
    firsts, lead = [], 0
    for h, f in spans:
        firsts.append(f[:-1] + lead)
        lead += len(h)
    first = np.concatenate([*firsts, [lead]]).astype(np.int64)
    ids, got = ids.astype(np.uint16)[number], {}
    for name, x in (("known", (count > 0).astype(np.float64)), ("base", np.log10(count + 0.5)), ("tail", own)):
        total = np.concatenate(([0.0], np.cumsum(x[number])))
        got[name] = total[first[1:]] - total[first[:-1]]
    ln = model.score([ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]) + got["tail"]
    C.trim()
    return pa.table(
        {
            "doc_id": table.column("doc_id"), "train": table.column("train"), "n_tokens": pa.array(np.diff(first) + 1), "n_known": pa.array(np.rint(got["known"]).astype(np.int64) + int(v.ends > 0)),
            "base": pa.array(got["base"] + np.log10(v.ends + 0.5)), "score": pa.array(ln / np.log(10)),
        }
    )


def _note(head: int):
    """Of a key partition: sums of tail classes, and its commonest words."""

    def note(keys: np.ndarray, answers: np.ndarray) -> bytes:
        tail, n = ((answers >> np.uint64(40)) & np.uint64(127)).astype(np.int64), (answers & _COUNT).astype(np.int64)
        top = np.argsort(-n, kind="stable")[:head]
        top = top[n[top] > 0]
        sums = np.concatenate((np.bincount(tail, n, TAILS), np.bincount(tail, n > 0, TAILS))).astype(np.int64)
        return sums.tobytes() + keys[top].tobytes() + n[top].tobytes() + tail[top].tobytes()

    return note


def _noted(batches):
    """Rows (word, n, v, tail) of notes: sums of tail classes have no word."""
    for b in batches:
        for cell in b.column("answer").to_pylist():
            x = np.frombuffer(cell, np.int64)
            sums, rest = x[: 2 * TAILS].reshape(2, -1), x[2 * TAILS :].reshape(3, -1)
            word = pa.array([None] * TAILS + rest[0].tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([word, pa.array(np.concatenate((sums[0], rest[1]))), pa.array(np.concatenate((sums[1], np.ones(rest.shape[1], np.int64)))), pa.array(np.concatenate((np.arange(TAILS), rest[2])))], ["word", "n", "v", "tail"])


def likelihoods(docs: DataFrame, *, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~F.coalesce(fold() == 1, F.lit(False))).alias("train"))
    to = X.layout(docs)
    batches = X.batched(docs, to)
    totals = X.exchange(batches, to.parts, _tokens, _sums, "uint64", "uint64", wide=True, note=_note(head))
    totals = X.Answers(C.stored(totals.rows, "counts"), totals.kind)

    noted = totals.rows.where("batch = -1").select("answer").mapInArrow(_noted, "word long, n long, v long, tail long")
    sums = {r["tail"]: (r["n"], r["v"]) for r in noted.where("word is null").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n_k, v_k = (np.array([sums.get(i, (0, 0))[j] for i in range(TAILS)], np.int64) for j in (0, 1))
    ends = docs.where("train").count()
    train_tokens, distinct = int(n_k.sum()) + ends, int(v_k.sum()) + int(ends > 0)
    top = noted.where("word is not null").orderBy(F.desc("n"), "word").limit(head).collect()
    keys = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    head_count = np.array([r["n"] for r in top], np.int64)
    for r in top:
        n_k[r["tail"]] -= r["n"]
        v_k[r["tail"]] -= 1
    vocab = Vocabulary(keys, head_count, n_k, v_k, ends)
    model = GRU(vocab)
    about = (keys, head_count, n_k, v_k, ends)
    read = learn_all(docs.where("train").select("doc_id", "text"), to, model, about)
    if read != train_tokens:
        raise RuntimeError(f"trained on {read} tokens of {train_tokens}")
    box = spark.sparkContext.broadcast((*about, model.p))

    def score(table: pa.Table, counts: np.ndarray) -> pa.Table:
        *about, params = box.value
        return _scored(table, counts, GRU(Vocabulary(*about), params=params))

    rows = X.consume(batches, (totals,), score, "doc_id long, train boolean, n_tokens long, n_known long, base double, score double")
    floor = F.lit(float(np.log10(train_tokens + 0.5 * (distinct + 1))))
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")
