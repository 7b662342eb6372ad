"""Problem 9: abusive, hateful or sexual language.

Method: a support vector machine with a gap-weighted subsequence kernel over sentences, on Nyström
landmarks. The kernel compares all subsequences of five letters that span at most six, each gap
weighing ``GAP``, so that inserted, left-out or masked letters cost little. Landmarks are labelled
sentences; in their whitened feature space a squared-hinge machine is trained. Its decision is linear in
the subsequences, sum_l b_l k(x, l) = phi(x) . sum_l b_l phi(l), so the landmarks are folded into one
table of weights by subsequence, and a corpus of any size is scored by table look-ups.

Ratings are of documents, the machine needs sentences: of a document rated abusive by most, the sentence
is taken as the labelled one whose words and pairs of words other abusive documents share and clean ones
lack; documents in which none stands out are taken for wrong ratings. Further rounds add what the machine
itself finds in them, and the clean sentences it is nearest to mistake.

The fit uses at most ``LABELLED`` rated documents of ``FIT_CHARS`` characters together, chosen by a hash of their
ids. All documents are scored,
over their whole texts.

Defined results: null or empty texts have score null and are no case; documents without a source count
under a null source; repeated ratings count once, null ratings do not count, ties leave a document out.
Without ratings of both kinds no document is a case.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELLED = 12_000
#: Characters of the rated documents that are fitted, in all.
FIT_CHARS = 48_000_000
LANDMARKS, ROUNDS, NEGATIVES = 420, 2, 2_000
GAP = 0.6
#: The decision value of a sentence that is like no landmark: what is unknown is no case.
BIAS = -1.0
BITS = 20
LEAST_LETTERS = 5  # codes, with the blanks around a sentence
#: Word odds from which a sentence is taken for what raters meant.
STANDS_OUT = 1.6
#: Places where at least ``MANY`` different words stand, and word odds, with which a word is abusive by itself.
MANY, BESIDE, ALONE = 5, 3, 2.2
#: Offsets of the second to fifth letter of a subsequence, and factors that mix the letters' codes.
PATTERNS = [(a, b, c, d) for d in range(4, 6) for a in range(1, d) for b in range(a + 1, d) for c in range(b + 1, d)]
WEIGHTS = np.array([GAP ** (p[-1] - 4) for p in PATTERNS], dtype=np.float32)
FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]
DROP, SPACE, END, NAME = 0, 1, 2, 62
# Latin and other letters, and marks inside words, by the letter they are read as.
READ_AS = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у", "ё": "е", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d"}
INSIDE = {"@": "а", "$": "s", "0": "о", "3": "е", "6": "б", "1": "i"}


def _codes() -> np.ndarray:
    """Code of each code point below 0x3000: letters from 3 up, SPACE, END, or DROP."""
    out = np.full(0x3001, SPACE, dtype=np.uint8)
    known: dict[str, int] = {}
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[0] if c.lower() not in "йї" else c.lower()
            base = READ_AS.get(base, base)
            out[cp] = known.setdefault(base, 3 + len(known)) if "а" <= base <= "я" or "a" <= base <= "z" else 63
        elif c.isdigit() or c in "*_@$#%^'’`´·~" or unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc"):
            out[cp] = DROP
    for c in "\n\r!?:;|":
        out[ord(c)] = END
    out[ord("\t")] = SPACE
    for c, to in INSIDE.items():
        out[ord(c)] = 64 + known[to]  # a letter only between letters
    out[ord(".")] = 255
    return out


CODES = _codes()
#: Characters that stand for plain letters in another form.
COMPATIBLE = re.compile("[ª²³¹ºʰ-ʸᴬ-ᵪᵸⁱ-ₜ℀-⅏⅐-ↈ①-⓿ꚜꚝ\uf900-\ufaff\ufb00-\ufb06\uff01-\uff5e\U0001d400-\U0001d7ff\U0001f100-\U0001f18f]")
UPPER = np.array([chr(cp).isupper() for cp in range(0x3001)])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one row of codes with ENDs between sentences, a SPACE at both ends of each sentence, and for
    each code its text's number. Compatibility forms (full-width, mathematical, circled letters) are read as
    the letters they stand for. A word that is written as names in code are is one NAME: a capital first, more inside, in
    parts of three letters or at least three parts. A run of three equal letters is one."""
    cps = [np.frombuffer((unicodedata.normalize("NFKC", t) if COMPATIBLE.search(t) else t).encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(x) + 1 for x in cps])
    flat = np.full(sizes.sum(), 10, dtype=np.uint32)
    at = 0
    for x in cps:
        flat[at : at + len(x)] = x
        at += len(x) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code = CODES[np.minimum(flat, 0x3000)]
    code[flat > 0x3000] = SPACE
    letter = (code > END) & (code < 64)
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    mark = (code >= 64) & (code < 255)
    code[mark] = np.where((before & after)[mark], code[mark] - 64, DROP)
    dot = code == 255
    code[dot] = np.where(after[dot], DROP, END)
    keep = code != DROP
    upper = UPPER[np.minimum(flat, 0x3000)][keep]
    code, owner = code[keep], owner[keep]
    inside = np.flatnonzero(upper[1:] & ~upper[:-1] & (code[1:] > END) & (code[:-1] > END)) + 1
    if len(inside):
        name = _names(code, upper, inside)
        first = name & np.concatenate([[True], ~name[:-1]])
        code[first] = NAME
        keep = first | ~name
        code, owner = code[keep], owner[keep]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~((code[1:] <= END) & (code[:-1] == code[1:]))
    code, owner = code[keep], owner[keep]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    length = np.diff(np.concatenate([start, [len(code)]]))
    keep = np.ones(len(code), dtype=bool)
    for s, n in zip(start[length > 2], length[length > 2]):
        keep[s + 1 : s + n] = False
    code, owner = code[keep], owner[keep]
    end = np.flatnonzero(code == END)
    if len(end):  # blanks where a sentence begins or ends without one
        opens, closes = np.concatenate([[0], end[:-1] + 1]), end
        opens = opens[(code[opens] != SPACE) & (code[opens] != END)]
        closes = closes[(closes > 0) & (code[closes - 1] > END)]
        code, owner = np.insert(code, np.concatenate([opens, closes]), SPACE), np.insert(owner, np.concatenate([opens, closes]), np.concatenate([owner[opens], owner[closes]]))
    return code, owner


def _names(code: np.ndarray, upper: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which codes belong to a name; ``inside`` are the places of capitals within words."""
    word = np.cumsum(code <= END)
    size, first = np.bincount(word), np.searchsorted(word, np.arange(word[-1] + 1))
    first += code[np.minimum(first, len(code) - 1)] <= END
    size = size - (np.bincount(word, weights=code <= END) > 0)
    n = np.bincount(word[inside], minlength=len(size))
    edge = np.concatenate([inside, first[n > 0], (first + size)[n > 0]])
    edge = np.sort(edge)
    part = np.diff(edge)
    whose = word[edge[:-1]]
    same = whose == word[edge[1:] - 1]
    least = np.full(len(size), 1 << 30)
    np.minimum.at(least, whose[same], part[same])
    capital = upper[np.minimum(first, len(upper) - 1)]
    return ((n > 0) & (3 * n <= size) & (size >= 7) & capital & ((least >= 3) | (n >= 2)))[word] & (code > END)


def sentences(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, owner) of the sentences long enough."""
    end = np.flatnonzero(code == END)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else np.zeros(0, dtype=np.int64)
    ok = end - start >= LEAST_LETTERS
    return start[ok], end[ok], owner[start[ok]] if len(code) else start


def subsequences(code: np.ndarray):
    """For each pattern the hashed subsequence that begins at each place; the last places have none."""
    n = max(0, len(code) - PATTERNS[-1][-1])
    mixed = [code.astype(np.uint32) * f for f in FACTORS]
    for p in PATTERNS:
        key = mixed[0][:n].copy()
        for m, at in zip(mixed[1:], p):
            key += m[at : at + n]
        key ^= key >> np.uint32(15)
        key *= np.uint32(2246822519)
        key >>= np.uint32(32 - BITS)
        yield key


def _norm(lengths: np.ndarray) -> np.ndarray:
    """The norm of a sentence's subsequences, counting each occurrence once."""
    return np.sqrt(float((WEIGHTS.astype(np.float64) ** 2).sum()) * np.maximum(lengths - 4.0, 1.0))


def score(code: np.ndarray, start: np.ndarray, stop: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The decision value of each sentence. Places before a sentence's end reach over it and weigh nothing
    but by chance, as no landmark holds an END."""
    code = np.concatenate([code, np.full(8, END, np.uint8)])
    value = np.zeros(len(code), dtype=np.float32)
    for w, key in zip(WEIGHTS, subsequences(code)):
        value[: len(key)] += w * table[key]
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return (total[np.maximum(stop - 4, start)] - total[start]) / _norm(stop - start) + bias


class Machine:
    """Fits the table of weights from sentences of rated documents."""

    def __init__(self, texts: list[str], abusive: np.ndarray, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        code, owner = letters(texts)
        start, stop, own = sentences(code, owner)
        seen: dict[bytes, int] = {}
        self.parts: list[bytes] = []
        self.docs: list[list[int]] = [[] for _ in texts]
        for s, e, o in zip(start.tolist(), stop.tolist(), own.tolist()):
            raw = b"\x01" + code[s:e].tobytes().strip(b"\x01") + b"\x01"
            k = seen.get(raw)
            if k is None:
                k = seen[raw] = len(self.parts)
                self.parts.append(raw)
            self.docs[o].append(k)
        self.abusive = abusive
        self.code, self.start, self.stop = self._joined(range(len(self.parts)))

    def _joined(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """These sentences as one row of codes, far enough apart that no subsequence crosses."""
        own = [self.parts[i] for i in rows]
        code = np.frombuffer(b"".join([p + b"\x02" * 8 for p in own]), np.uint8)
        lens = np.array([len(p) for p in own], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(lens + 8)])[:-1].astype(np.int64)
        return code, start, start + lens

    def _word_odds(self) -> np.ndarray:
        """How far a sentence's words and pairs of words speak for abusive documents other than its own."""
        def of(part: bytes) -> set:
            w = [x for x in part.split(b"\x01") if x]
            return {*w, *zip(w, w[1:])} - {b"\x3e"}

        grams = [of(p) for p in self.parts]
        pos: dict = {}
        neg: dict = {}
        for doc, bad in zip(self.docs, self.abusive):
            if bad:
                for g in set().union(*[grams[i] for i in doc]):
                    pos[g] = pos.get(g, 0) + 1
        pos = {g: n for g, n in pos.items() if n > 1}
        for doc, bad in zip(self.docs, self.abusive):
            if not bad:
                for g in set().union(*[grams[i] for i in doc]).intersection(pos):
                    neg[g] = neg.get(g, 0) + 1
        n_pos, n_neg = self.abusive.sum() + 1, (~self.abusive).sum() + 1
        odds = {g: float(np.log((n - 0.9) / n_pos) - np.log((neg.get(g, 0) + 0.5) / n_neg)) for g, n in pos.items()}
        self.odds = odds
        self.kind: list = [b""] * len(grams)
        out = np.full(len(grams), -1.0)
        for i, gs in enumerate(grams):
            top = sorted([(odds[g], g) for g in gs if g in odds], key=lambda x: -x[0])[:4]
            if len(gs) > 3 and top:
                out[i] = (sum(x for x, _ in top) - (4 - len(top))) / 4
                self.kind[i] = max(top, key=lambda x: (isinstance(x[1], tuple), pos[x[1]], str(x[1])))[1]
        return out

    def _alone(self, chosen: set) -> set:
        """Insults as sentences of their own: words of abusive documents that stand in places, by the words beside
        them, where many different words stand. What insults in many sentences does so alone."""
        there: dict = {}
        for i in sorted(chosen):
            w = [x for x in self.parts[i].split(b"\x01") if x]
            for a, x, b in zip([b"", *w], w, [*w[1:], b""]):
                there.setdefault((a, b), set()).add(x)
        places: dict = {}
        for words in there.values():
            if len(words) >= MANY:
                for x in words:
                    places[x] = places.get(x, 0) + 1
        words = sorted(x for x, n in places.items() if n >= BESIDE and len(x) >= 4 and self.odds.get(x, 0) > ALONE)
        first = self.first_alone = len(self.parts)
        self.parts += [b"\x01" + x + b"\x01" for x in words]
        self.kind += words
        self.code, self.start, self.stop = self._joined(range(len(self.parts)))
        return set(range(first, len(self.parts)))

    def _varied(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Up to ``n`` of the rows, taken in turn from groups by the word that speaks most for them."""
        order = self.rng.permutation(rows)
        turn: dict = {}
        ranked = []
        for i in order:
            turn[self.kind[i]] = turn.get(self.kind[i], 0) + 1
            ranked.append((turn[self.kind[i]], len(ranked), i))
        return np.array([i for *_, i in sorted(ranked)[:n]], dtype=np.int64)

    def fit(self) -> tuple[np.ndarray, float]:
        odds = self._word_odds()
        table, bias = np.zeros(1 << BITS, np.float32), BIAS
        held = [np.unique(d) for d in self.docs]
        clean = np.unique(np.concatenate([h for h, bad in zip(held, self.abusive) if not bad] or [np.zeros(0, int)])).astype(np.int64)
        chosen = {int(h[np.argmax(odds[h])]) for h, bad in zip(held, self.abusive) if bad and len(h) and odds[h].max() > STANDS_OUT}
        negative = clean[odds[clean] < STANDS_OUT]  # a clean rating of what other raters call abusive is an error
        if not chosen or not len(negative):
            return table, bias
        hard = negative[np.argsort(-odds[negative])[: NEGATIVES // 2]]
        held_alone = self._alone(chosen)
        chosen |= held_alone
        for rnd in range(ROUNDS):
            some = self.rng.choice(negative, min(len(negative), NEGATIVES), replace=False)
            table, bias = self._train(np.array(sorted(chosen)), np.union1d(hard, some), hard)
            value = score(self.code, self.start, self.stop, table, bias)
            hard = np.union1d(hard[: NEGATIVES // 2], negative[np.argsort(-value[negative])[: NEGATIVES // 2]])
            if rnd < ROUNDS - 1:
                chosen |= {int(i) for h, bad in zip(held, self.abusive) if bad for i in h if value[i] > 0.2 and odds[i] > 0}
        return table, bias

    def _train(self, pos: np.ndarray, neg: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, float]:
        alone = pos >= self.first_alone
        a = np.concatenate([self._varied(pos[~alone], LANDMARKS * 3 // 4), pos[alone]])
        marks = np.concatenate([a, self.rng.choice(hard, min(LANDMARKS // 4, len(hard)), replace=False)])
        code, start, stop = self._joined(marks)
        where = np.zeros(1 << BITS, dtype=np.int32)  # row 0 stands for all that no landmark has
        mine = np.repeat(np.arange(len(marks)), np.maximum(stop - start - 4, 0))
        places = np.concatenate([np.arange(a, max(a, b - 4)) for a, b in zip(start, stop)])
        keys = [k[places] for k in subsequences(code)]
        used = np.unique(np.concatenate(keys))
        where[used] = np.arange(1, len(used) + 1)
        phi = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)
        for w, k in zip(WEIGHTS, keys):
            np.add.at(phi, (where[k], mine), w)
        phi /= _norm(stop - start)[None, :].astype(np.float32)

        def kernel(rows):
            out = np.zeros((len(rows), len(marks)))
            for lo in range(0, len(rows), 256):
                code, start, stop = self._joined(rows[lo : lo + 256])
                n = np.maximum(stop - start - 4, 0)
                places = np.concatenate([np.arange(a, a + m) for a, m in zip(start, n)])
                live = np.flatnonzero(n)
                edge = np.concatenate([[0], np.cumsum(n[live])])[:-1]
                part = np.zeros((len(start), len(marks)), dtype=np.float32)
                for w, k in zip(WEIGHTS, subsequences(code)):
                    at = where[k[places]]
                    hit = at > 0
                    if hit.any():
                        row = np.repeat(live, n[live])[hit]
                        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        part[row[first]] += w * np.add.reduceat(phi[at[hit]], first, axis=0)
                out[lo : lo + 256] = part / _norm(stop - start)[:, None]
            return out

        kmm = kernel(marks)
        vals, vecs = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-3 * np.eye(len(marks)))
        white = vecs / np.sqrt(np.maximum(vals, 1e-6))
        rows = np.concatenate([pos, neg])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        x = kernel(rows) @ white
        cost = np.where(y > 0, 1.0, np.sqrt(len(pos) / len(neg)) * 2) * 10
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps of the squared hinge
            live = y * (x @ w + BIAS) < 1
            if not live.any():
                live = np.ones(len(y), dtype=bool)
            xs, cs = x[live], cost[live]
            new = np.linalg.solve((xs * cs[:, None]).T @ xs + np.eye(x.shape[1]), (xs * cs[:, None]).T @ (y[live] - BIAS))
            if np.allclose(new, w, atol=1e-6):
                break
            w = new
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[used] = phi[1:] @ (white @ w).astype(np.float32)
        return table, BIAS


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """The machine for these ratings, from at most ``labelled`` rated documents."""
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id", "rater").agg(F.max("abusive").alias("abusive")).groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "share").agg(F.min("text").alias("text"))
    # At most ``labelled`` rows, in one order.
    so_far = F.sum(F.length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= FIT_CHARS).select("doc_id", "share", "text").collect()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    abusive = np.array([r["share"] > 0.5 for r in rows], dtype=bool)
    if not abusive.any() or abusive.all():
        return np.zeros(1 << BITS, np.float32), BIAS
    return Machine([r["text"] for r in rows], abusive).fit()


def scores(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, source, score): the highest decision value of a document's sentences; above 0 is a case."""
    shipped = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, labelled))

    def run(batches):
        table, bias = shipped.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                texts = [t or "" for t in b.column("text").to_pylist()]
                code, owner = letters(texts)
                start, stop, own = sentences(code, owner)
                best = np.full(len(texts), -np.inf)
                if len(start):
                    np.maximum.at(best, own, score(code, start, stop, table, bias))
                best[np.isneginf(best)] = bias
                empty = np.array([not t.strip() for t in texts])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(best, mask=empty)], ["doc_id", "source", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p9_found: the documents with such language."""
    return scores(documents, labels).where("score > 0").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, n_abusive, rate)."""
    s = scores(documents, labels)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce((F.col("score") > 0).cast("bigint"), F.lit(0))).alias("n_abusive"), F.round(F.avg(F.coalesce((F.col("score") > 0).cast("double"), F.lit(0.0))), 6).alias("rate"))
