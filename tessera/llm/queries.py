"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.llm import abuse, docpairs, leaks, near, pieces, syntax, tokenize, vectors
from tessera.util import read, shared_dir


def queries() -> dict:
    def table(name):
        return lambda spark, d: read(spark, d, name)

    files, units, routines, symbols = table("files"), table("doc_units"), table("routines"), table("symbols")
    documents, items, labels, chunks, vecs = table("documents"), table("eval_items"), table("abuse_labels"), table("chunks"), table("chunk_vectors")
    return {
        "p1_found": lambda s, d: syntax.invalid_files(files(s, d)),
        "p1_rates": lambda s, d: syntax.rates(files(s, d)),
        "p1_verdicts": lambda s, d: syntax.verdicts(files(s, d)),
        "p2_found": lambda s, d: pieces.oversized(units(s, d), routines(s, d), files(s, d)),
        "p2_pieces": lambda s, d: pieces.pieces(units(s, d), routines(s, d), files(s, d)),
        "p2_file_pieces": lambda s, d: pieces.corpus_pieces(units(s, d), f"{shared_dir(s)}/corpus-{uuid.uuid4().hex}"),
        "p2_report": lambda s, d: pieces.piece_report(units(s, d), routines(s, d), files(s, d)),
        "p4_found": lambda s, d: vectors.mutual(vecs(s, d)),
        "p4_nearest": lambda s, d: vectors.nearest(vecs(s, d), cosine=0.4, recall=0.98, queries=F.col("vec_id") % 20 == 0),
        "p5_found": lambda s, d: near.pairs(chunks(s, d)),
        "p5_groups": lambda s, d: near.groups(chunks(s, d)),
        "p5_owners": lambda s, d: near.owners(chunks(s, d)),
        "p6_found": lambda s, d: docpairs.found(symbols(s, d), files(s, d)),
        "p6_pairs": lambda s, d: docpairs.code_pairs(symbols(s, d), files(s, d)),
        "p7_ids": lambda s, d: tokenize.encode(documents(s, d)),
        "p7_counts": lambda s, d: tokenize.counts(documents(s, d)),
        "p8_found": lambda s, d: leaks.leaks(documents(s, d), items(s, d)),
        "p8_passages": lambda s, d: leaks.closest(documents(s, d), items(s, d)),
        "p8_items": lambda s, d: leaks.leaked_items(documents(s, d), items(s, d)),
        "p9_found": lambda s, d: abuse.found(documents(s, d), labels(s, d)),
        "p9_scores": lambda s, d: abuse.scores(documents(s, d), labels(s, d)),
        "p9_rates": lambda s, d: abuse.rates(documents(s, d), labels(s, d)),
    }


WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": rf"""
            WITH u AS (SELECT DISTINCT unit_id, text FROM doc_units WHERE text IS NOT NULL),
            r AS (SELECT DISTINCT routine_id, file_id, start_line, end_line FROM routines WHERE start_line IS NOT NULL),
            f AS (SELECT file_id, string_split(CASE WHEN content[1] = chr(65279) THEN content[2:] ELSE content END, chr(10)) AS lines FROM files WHERE content IS NOT NULL),
            t AS (
                SELECT 'doc_unit' AS item_kind, unit_id AS item_id, CASE WHEN text[1] = chr(65279) THEN text[2:] ELSE text END AS body FROM u
                UNION ALL
                SELECT 'routine', routine_id, array_to_string(lines[start_line:coalesce(end_line, len(lines))], chr(10)) FROM r JOIN f USING (file_id))
            SELECT item_kind, item_id FROM t WHERE length(regexp_replace(body, '{WHITE}', '', 'g')) > 1200""",
        "p4_found": """
            WITH v AS (SELECT DISTINCT vec_id, field_name, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64),
            n AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM n a JOIN n b ON a.field_name = b.field_name AND a.vec_id <> b.vec_id),
            t AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS place FROM p)
            SELECT x.a AS vec_a, x.b AS vec_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.9 AND x.place <= 5 AND y.place <= 5""",
        "p5_found": r"""
            WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM chunks WHERE text IS NOT NULL),
            s AS (SELECT DISTINCT chunk_id, x FROM (SELECT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) >= 40)),
            n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
            SELECT a AS chunk_a, b AS chunk_b FROM c JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE both_n::DOUBLE / (x.n + y.n - both_n) >= 0.6""",
    }
