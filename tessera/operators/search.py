"""Search: hashing embedder, exact cosine, BM25 over postings, fusion of ranked lists.

Query texts and query vectors are small stated sets; the corpus side is read once, filtered before it is
ranked, and only the best rows of each query meet in one place. Scores are doubles rounded to 6 digits;
ties go by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """Words by white space, lower case, counted at blake2b-8 modulo ``dim``, scaled to length 1."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>"

    def run(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        known: dict = {}
        for b in batches:
            out = []
            for t in b[text]:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    at = known.get(w)
                    if at is None:
                        if len(known) > 500_000:
                            known.clear()
                        at = known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % dim
                    v[at] += 1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32"))
            yield pd.DataFrame({key: b[key], "embedding": out})

    return df.select(key, text).mapInPandas(run, schema)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    # The length goes through an array of one, since an expression inside a lambda is worked out anew for every element.
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def rounded(x: Column, digits: int) -> Column:
    """A double of at most 2^52 / 10^digits rounded as in SQL by DuckDB and not as by ``F.round``: on the double times
    10^digits instead of its decimal digits, halves away from zero, and a negative that rounds to zero is -0.0."""
    scale = F.lit(10.0**digits)
    size = F.abs(x) * scale
    whole = F.floor(size)
    return F.signum(x) * (whole + F.when(size - whole >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is zero or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot / n)


#: Vectors of one side that are sent to the workers at once.
HELD = 4096


def _blocks(df: DataFrame, key: str, vector: str):
    """(keys, unit vectors) of blocks of about ``HELD`` rows, one after another; rows with null, zero or odd
    vectors are left out, repeated keys count once."""
    import numpy as np

    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).dropDuplicates([key])
    first = rows.limit(HELD + 1).collect()
    n = 1 if len(first) <= HELD else -(-rows.count() // HELD)
    for block in range(n):
        by_length: dict[int, list] = {}
        for r in first if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == block).collect():
            x = np.array(r[1], dtype=np.float64)
            if np.isfinite(x).all() and (size := np.linalg.norm(x)) > 0:
                by_length.setdefault(len(x), []).append((r[0], x / size))
        for found in by_length.values():
            yield [k for k, _ in found], np.stack([x for _, x in found])


def _against(stream: DataFrame, key: str, vector: str, held, k: int, by_held: bool) -> DataFrame:
    """(key, other, c): cosines of the stream's rows with a block of held vectors, the best ``k`` of each held row in a
    batch, or of each row of the stream."""
    import numpy as np

    names, matrix = held
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    shipped = stream.sparkSession.sparkContext.broadcast((names, matrix))
    as_text = isinstance(names[0], str)

    def run(batches):
        import pandas as pd

        names, matrix = shipped.value
        for b in batches:
            b = b.drop_duplicates(key)  # else a repeated row would take a place
            ok = [i for i, v in enumerate(b[vector]) if v is not None and len(v) == matrix.shape[1]]
            if not ok:
                continue
            x = np.stack([b[vector].iloc[i] for i in ok]).astype(np.float64)
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            c = (x[good] / size[good][:, None]) @ matrix.T
            mine = b[key].iloc[ok][good].to_numpy()
            n = min(k, c.shape[0 if by_held else 1])
            if not len(mine):
                continue
            if by_held:
                least = np.partition(c, -n, axis=0)[-n]
                row, col = np.nonzero(c >= least[None, :] - 1e-6)
            else:
                least = np.partition(c, -n, axis=1)[:, -n]
                row, col = np.nonzero(c >= least[:, None] - 1e-6)
            yield pd.DataFrame({"key": mine[row], "other": [names[j] for j in col], "c": c[row, col]})

    return stream.select(key, vector).mapInPandas(run, f"key {kinds[key]}, other {'string' if as_text else 'bigint'}, c double")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors most alike to each query vector (query_id, qvec), with (1 + cosine) / 2 as score; cosines
    equal to six digits go by vec_id. The queries, a stated set of any size, go to the workers in blocks, and the
    vectors are streamed past each; of a batch only the best rows of a query are shuffled."""
    v = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding")
    found = None
    for held in _blocks(queries, "query_id", "qvec"):
        one = _against(v, "vec_id", "embedding", held, k, True).select(F.col("other").alias("query_id"), F.col("key").alias("vec_id"), "c")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = v.select(F.lit(0).cast("bigint").alias("query_id"), "vec_id", F.lit(0.0).alias("c")).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.round("c", 6).desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("c").alias("c"))  # rows delivered twice
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "vec_id", F.round((1 + F.col("c")) / 2, 6).alias("score"), "place")


def chunk_filter(chunks: DataFrame, tenants: list[str] | None = None, kinds: list[str] | None = None, sources: list[str] | None = None, configs: list[str] | None = None) -> DataFrame:
    """Optional facets; None does not filter, an empty list lets nothing pass, null facets do not match."""
    for column, allowed in (("tenant_id", tenants), ("chunk_kind", kinds), ("source", sources), ("config_id", configs)):
        if allowed is not None:
            chunks = chunks.where(F.col(column).isin(allowed)) if allowed else chunks.where(F.lit(False))
    return chunks


def selectivity(chunks: DataFrame, cap: int = 50_000) -> DataFrame:
    """Whether so few rows pass a filter that an exact scan is cheap; counting stops at the cap."""
    return chunks.limit(cap).agg(F.count(F.lit(1)).alias("n")).select((F.col("n") < cap).alias("exact"))


def postings(df: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """(key, token, tf, dl): term frequencies weighted by field, and the row's length in tokens. A row is read into
    tokens once, its length with them; one shuffle counts."""
    rows = df.select(key, *[tokens(F.col(f)).alias(f"__{f}") for f in fields])
    rows = rows.withColumn("dl", sum(F.size(f"__{f}") for f in fields).cast("bigint")).where("dl > 0")

    def weighed(f: str, w: int) -> Column:
        return F.transform(f"__{f}", lambda t: F.struct(t.alias("token"), F.lit(w).cast("bigint").alias("w")))

    return rows.select(key, "dl", F.explode(F.concat(*[weighed(f, w) for f, w in fields.items()])).alias("t")).groupBy(key, "dl", "t.token").agg(F.sum("t.w").alias("tf")).select(key, "token", "tf", "dl")


class FullText:
    """An inverted index in a folder: postings in partitions by the first letters of a token, sorted by
    token, and one row of statistics. A search reads the partitions of its terms, and of these, by the statistics of
    their row groups, only the terms; a term's prefix of three letters or more lies in one partition too."""

    BUCKETS, LETTERS = 64, 3

    def __init__(self, spark, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def build(cls, df: DataFrame, key: str, fields: dict[str, int], path: str) -> FullText:
        out = cls(df.sparkSession, path, key)
        p = postings(df, key, fields).withColumn("bucket", cls.bucket_of(F.col("token")))
        p.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(f"{out.path}/postings")
        dl = out.spark.read.parquet(f"{out.path}/postings").select(key, "dl").distinct()
        dl.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{out.path}/stats")
        return out

    @classmethod
    def bucket_of(cls, token: Column) -> Column:
        return F.pmod(F.crc32(F.substring(token, 1, cls.LETTERS).cast("binary")), F.lit(cls.BUCKETS)).cast("int")

    @classmethod
    def _bucket(cls, token: str) -> int:
        import zlib

        return zlib.crc32(token[: cls.LETTERS].encode()) % cls.BUCKETS

    def table(self) -> DataFrame:
        """The postings; the listing of their files is kept for further searches."""
        if self.__dict__.get("_table") is None:
            self._table = self.spark.read.parquet(f"{self.path}/postings")
        return self._table

    def stats(self):
        """The one row of statistics."""
        if self.__dict__.get("_stats") is None:
            self._stats = self.spark.read.parquet(f"{self.path}/stats").first()
        return self._stats

    def postings_of(self, terms: list[tuple[str, bool]]) -> DataFrame:
        """(key, at, tf, dl): the postings of terms (token, prefix), ``at`` the term's place in the list; in one scan, with
        the filters on partitions and tokens pushed to the files."""
        token = F.col("token")
        means = [token.startswith(t) if prefix else token == t for t, prefix in terms]
        rows = self.table()
        if all(not prefix or len(t) >= self.LETTERS for t, prefix in terms):
            rows = rows.where(F.col("bucket").isin(sorted({self._bucket(t) for t, _ in terms})))
        any_of = means[0]
        for m in means[1:]:
            any_of = any_of | m
        which = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in enumerate(means)]))
        return rows.where(any_of).select(self.key, F.explode(which).alias("at"), "tf", "dl")

    def search(self, queries: dict[int, str], k: int = 10, form: str = "bm25") -> DataFrame:
        """(query_id, key, score, place, total): BM25 with k1 1.2, b 0.75. ``form`` "bm25" has the logarithm of
        1 + the odds, "fts" that of the odds themselves, at least 1e-6. How many rows each of the queries' few terms has
        is counted first; then one shuffle by key sums what a row has of each query's terms."""
        import math

        asked = [(q, t, p) for q, text in queries.items() for t, p in query_terms(text)]
        if not asked:
            raise ValueError("no query holds a word")
        terms = list(dict.fromkeys((t, p) for _, t, p in asked))
        found = self.postings_of(terms).repartition(self.key).groupBy("at", self.key).agg(F.sum("tf").cast("double").alias("tf"), F.min("dl").alias("dl"))
        df = {r["at"]: r["count"] for r in found.groupBy("at").count().collect()}  # a row a term
        n_docs, avgdl = self.stats()["n_docs"] or 0, self.stats()["avgdl"] or 1.0

        def idf(at: int) -> float:
            odds = (n_docs - df.get(at, 0) + 0.5) / (df.get(at, 0) + 0.5)
            return math.log(1 + odds) if form == "bm25" else max(math.log(odds), 1e-6) if odds > 0 else 1e-6

        own = F.array(*[F.array(*[F.lit(q).cast("bigint") for q, *tp in asked if tuple(tp) == t]) for t in terms])
        weight = F.element_at(F.array(*[F.lit(idf(n)) for n in range(len(terms))]), F.col("at") + 1)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        s = found.select(self.key, F.explode(F.element_at(own, F.col("at") + 1)).alias("query_id"), part.alias("part")).groupBy(self.key, "query_id").agg(F.round(F.sum("part"), 6).alias("score"))
        total = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(F.broadcast(total), "query_id").select("query_id", self.key, "score", "place", "total")


def snippet(text: Column, query: str, width: int = 12) -> Column:
    """``width`` words around the first that the query means, such words in brackets, … where the text goes on."""
    means = "|".join(f"{t}[0-9A-Za-zА-Яа-яЁё]*" if p else t for t, p in query_terms(query))
    lead = F.length(F.regexp_extract(text, rf"(?is)^(.*?)(?<![0-9A-Za-zА-Яа-яЁё])(?:{means})(?![0-9A-Za-zА-Яа-яЁё])", 1))
    words = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda x: x != "")
    before = F.size(F.filter(F.split(F.regexp_replace(F.substring(text, F.lit(1), lead), r"\s+", " "), " "), lambda x: x != ""))
    first = F.greatest(F.lit(0), before - width // 3)
    shown = F.array_join(F.slice(words, first + 1, width), " ")
    marked = F.regexp_replace(shown, rf"(?i)(?<![0-9A-Za-zА-Яа-яЁё])({means})(?![0-9A-Za-zА-Яа-яЁё])", "[$1]")
    return F.concat(F.when(first > 0, "…").otherwise(""), marked, F.when(F.size(words) > first + width, "…").otherwise(""))


def query_terms(text: str) -> list[tuple[str, bool]]:
    """Tokens of a query; Cyrillic ones of six letters or more match by their first letters too."""
    import re

    words = list(dict.fromkeys(re.findall("[0-9A-Za-zА-Яа-яЁё]+", text.lower())))
    return [(w[:-2], True) if len(w) >= 6 and re.fullmatch("[а-яё]+", w) else (w, False) for w in words]


def tokens(c: Column) -> Column:
    """The lower-case tokens of a text as an array, camel-case words beside the whole."""
    mark = "\x01"  # between the words of a camel-case part; one pass over the text finds all of them
    marked = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), mark, " "), "([a-zа-яё0-9])(?=[A-ZА-ЯЁ])", f"$1{mark}")
    parts = F.filter(F.split(F.lower(marked), f"[^0-9a-zа-яё{mark}]+"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(mark)), F.concat(F.array(F.replace(p, F.lit(mark), F.lit(""))), F.split(p, mark))).otherwise(F.array(p))))


def bm25(df: DataFrame, key: str, fields: dict[str, int], queries: dict[int, str], k: int = 10, form: str = "bm25") -> DataFrame:
    """V08, V09 over rows that have no index: one is built in the shared folder, then searched. Searches that come
    again keep their ``FullText``."""
    import uuid

    from tessera.util import shared_dir

    return FullText.build(df, key, fields, f"{shared_dir(df.sparkSession)}/index-{uuid.uuid4().hex}").search(queries, k, form)


def unit_of(fqn: Column) -> Column:
    """The routine of a code chunk, else the owner."""
    return F.substring_index(F.substring_index(fqn, "#code", 1), "#", 1)


def best_per_unit(rows: DataFrame) -> DataFrame:
    """Of a unit's chunks the one with the best score; the least id on ties."""
    return rows.groupBy("query_id", "unit").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("c"))).alias("b")).select("query_id", "unit", F.col("b.score").alias("score"), (-F.col("b.c")).alias("chunk_id"))


def rrf(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, unit, place from 1): the sum of 1 / (60 + rank)
    with ranks from 0, rounded to 5; ties go by the first list that has the unit, then its rank there."""
    rows = None
    for i, x in enumerate(lists):
        r = x.select("query_id", "unit", F.lit(i).alias("l"), (F.col("place") - 1).alias("rank"))
        rows = r if rows is None else rows.unionByName(r)
    f = rows.groupBy("query_id", "unit").agg(F.bround(F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))), 5).alias("score"), F.min(F.struct("l", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.l", "first.rank", "unit")
    return f.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "unit", "score", "place")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def semantic_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Two lists, by the vectors of text and of names, best chunk per unit, fused."""
    return rrf(_vector_lists(chunks, vectors, queries, k), k)


def _vector_lists(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> list[DataFrame]:
    unit = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", unit_of(F.col("fqn")).alias("unit"))
    out = []
    for field in ("text", "text_ident"):
        v = vectors.where(F.col("field_name") == field)
        top = exact_top_k(v, queries, 5 * k).join(v.select("vec_id", "chunk_id").distinct(), "vec_id").join(unit, "chunk_id")
        out.append(ranked(best_per_unit(top), k * 5))
    return out


def hybrid_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, texts: dict[int, str], index: FullText, k: int = 10) -> DataFrame:
    """The two vector lists and full text by an index of chunk_id, fused; nothing is asked per hit. What is not in
    ``chunks``, which may be filtered, is in no list."""
    c = chunks.dropDuplicates(["chunk_id"])
    full = index.search(texts, 5 * k).join(c.select("chunk_id", unit_of(F.col("fqn")).alias("unit")), "chunk_id")
    return rrf([*_vector_lists(chunks, vectors, queries, k), ranked(best_per_unit(full), k * 5)], k)


def rerank(hits: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """The hits ordered by another score, which may be a model's pandas function."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "unit")
    return hits.withColumn("rerank", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def expand(hits: DataFrame, callers: DataFrame, callees: DataFrame, limit: int = 8) -> DataFrame:
    """Neighbours of all hits in one join per side, at most ``limit`` of each, sorted."""
    a = callers.groupBy(F.col("callee").alias("unit")).agg(F.slice(F.array_sort(F.collect_set("caller")), 1, limit).alias("callers"))
    b = callees.groupBy(F.col("caller").alias("unit")).agg(F.slice(F.array_sort(F.collect_set("callee")), 1, limit).alias("callees"))
    return hits.join(a, "unit", "left").join(b, "unit", "left")


def readiness(objects: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per tenant whether it is vectorized, only structural, or empty."""
    o = objects.where("deleted_at is null").groupBy("tenant_id").agg(F.countDistinct("object_id").alias("n_objects"))
    c = chunks.groupBy("tenant_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    has = vectors.where("embedding is not null").select("chunk_id").distinct()
    v = chunks.select("tenant_id", "chunk_id").distinct().join(has, "chunk_id", "left_semi").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    t = o.join(c, "tenant_id", "full").join(v, "tenant_id", "left").na.fill(0, ["n_objects", "n_chunks", "n_vectors"])
    return t.withColumn("state", F.when(F.col("n_vectors") > 0, "vectorized").when(F.col("n_objects") > 0, "structural_only").otherwise("empty"))


def link_semantic(docs: DataFrame, objects: DataFrame, k: int = 3, least: float = 0.45) -> DataFrame:
    """Per document (query_id, qvec) its ``k`` objects (vec_id, embedding) at least ``least`` alike. The objects go
    to the workers in blocks, and the documents, which are the more, are streamed past each."""
    found = None
    for held in _blocks(objects, "vec_id", "embedding"):
        one = _against(docs.where("query_id is not null"), "query_id", "qvec", held, k, False)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.select("query_id", F.lit(0).cast("bigint").alias("vec_id"), F.lit(0.0).alias("confidence")).limit(0)
    w = Window.partitionBy("key").orderBy(F.round("c", 6).desc(), "other")
    found = found.groupBy("key", "other").agg(F.max("c").alias("c"))
    score = F.round((1 + F.col("c")) / 2, 4)
    return found.withColumn("place", F.row_number().over(w)).where((F.col("place") <= k) & (score >= least)).select(F.col("key").alias("query_id"), F.col("other").alias("vec_id"), score.alias("confidence"))


def standard_number(c: Column) -> Column:
    """The number in an id of a standard, ``std 123`` or ``#123``; null without one."""
    n = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(n != "", n.cast("bigint"))


def embed_with(df: DataFrame, key: str, text: str, make) -> DataFrame:
    """(key, embedding) by any encoder: ``make()`` is called once in each worker's task and gives a function from a
    list of texts to vectors; null texts are left out. The encoder's files must be where workers can read them."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>"

    def run(batches):
        import pandas as pd

        encode = None
        for b in batches:
            encode = encode or make()
            yield pd.DataFrame({key: b[key], "embedding": [list(map(float, v)) for v in encode(b[text].tolist())]})

    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)


def rerank_with(hits: DataFrame, query: str, text: str, make, k: int = 10) -> DataFrame:
    """The hits (query_id, unit, and columns of query and text) in the order of a model: ``make()`` gives a function
    from lists of queries and texts to scores. Only hits, of which each query has few, come to the model."""
    import pandas as pd

    def score(q, t):
        return pd.Series(make()(q.tolist(), t.fillna("").tolist()), dtype="float64")

    return rerank(hits, F.pandas_udf(score, "double", F.PandasUDFType.SCALAR)(F.col(query), F.col(text)), k)
