"""Queries of the training-data operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import mail_parts, mixing, near_copies, pieces, prose, scan_text, site_lines, token_ids, vector_graph
from quillspark.tables import table


def p1_found(spark, d):
    return pieces.oversized_blocks(table(spark, d, "chunks"), table(spark, d, "chunking_options"))


def p1_pieces(spark, d):
    return pieces.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunking_options"))


def p2_found(spark, d):
    return vector_graph.nearest(table(spark, d, "chunks"), k=5, least=0.85).select("chunk_id", "neighbor_id")


def p2_nearest(spark, d):
    return vector_graph.nearest(table(spark, d, "chunks"), k=5)


def p3_found(spark, d):
    return mail_parts.not_new_lines(table(spark, d, "emails"))


def p3_new_text(spark, d):
    return mail_parts.newly_written(table(spark, d, "emails"))


def _records(spark, d):
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("rec"), F.col("chunk_id").alias("id"), "text")
    return chunks.unionByName(table(spark, d, "contradiction_sides").select(F.lit("side").alias("rec"), F.col("side_id").alias("id"), F.col("excerpt").alias("text")))


def p4_found(spark, d):
    return near_copies.pairs_of_records(_records(spark, d), threshold=0.6, k=3, min_words=20)


def p4_groups(spark, d):
    return near_copies.groups(_records(spark, d), threshold=0.6, k=3, min_words=20)


def p5_found(spark, d):
    return scan_text.defects(table(spark, d, "pdf_lines"))


def p5_paragraphs(spark, d):
    return scan_text.paragraphs(table(spark, d, "pdf_lines"))


def p5_markdown(spark, d):
    return scan_text.repaired_markdown(table(spark, d, "conversions"), table(spark, d, "pdf_lines"))


def p6_found(spark, d):
    return site_lines.repeated_lines(table(spark, d, "chunks"))


def p6_cut_texts(spark, d):
    return site_lines.without_repeated_lines(table(spark, d, "chunks"))


def p7_ids(spark, d):
    return token_ids.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_filled(spark, d):
    """Half as many tokens as all sources with a target hold: the exponent is the least at which no source's repetition limit is broken."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), fill=0.5)


def p8_filled_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), fill=0.5)


def p8_leaning_shares(spark, d):
    """The exponent at which the weights' entropy lies halfway between that of the targets and the natural one."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), leaning=0.5)


def p9_found(spark, d):
    return prose.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_statistics(spark, d):
    return prose.quality_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_nearest, p3_found, p3_new_text, p4_found, p4_groups, p5_found, p5_paragraphs, p5_markdown, p6_found, p6_cut_texts, p7_ids, p8_mix, p8_shares, p8_filled, p8_filled_shares, p8_leaning_shares, p9_found, p9_statistics)}

#: Unicode white space for engines whose \s is ASCII.
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINES = "string_split(replace(text,chr(13)||chr(10),chr(10)),chr(10))"
_LOWER = "lower(replace({},'İ','i'||chr(775)))"

SQL: dict[str, str] = {
    # fences by the parity of fence lines so far; runs of non-blank lines by the blank lines so far
    "p1_found": f"""WITH o AS (SELECT c.chunk_id, coalesce(m.max_chars,1600) AS most, {_LINES} AS ls FROM chunks c LEFT JOIN (SELECT project, max(max_chars) AS max_chars FROM chunking_options GROUP BY project) m USING (project) WHERE text IS NOT NULL),
 l AS (SELECT chunk_id, most, i, ls[i] AS t FROM o, LATERAL (SELECT unnest(range(1,len(ls)+1)) AS i)),
 f AS (SELECT *, CAST(regexp_matches(t,'^{_WS}*(```|~~~)') AS INT) AS f, CAST(regexp_matches(t,'^{_WS}*$') AS INT) AS b FROM l),
 c AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY i) AS c, sum(b) OVER (PARTITION BY chunk_id ORDER BY i) AS bl FROM f),
 k AS (SELECT *, CASE WHEN c%2=1 OR f=1 THEN 'f'||((c+1)//2) WHEN b=0 THEN 'r'||c||'-'||bl END AS k FROM c),
 g AS (SELECT chunk_id, any_value(most) AS most, min(i) AS i, CAST(sum(length(t))+count(*)-1 AS BIGINT) AS n FROM k WHERE k IS NOT NULL GROUP BY chunk_id, k.k)
 SELECT chunk_id, CAST(no AS INTEGER) AS block_no FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY i)-1 AS no FROM g) WHERE n>most""",
    "p4_found": rf"""WITH r AS (SELECT 'chunk' AS rec, chunk_id AS id, text FROM chunks UNION ALL SELECT 'side', side_id, excerpt FROM contradiction_sides),
 w AS (SELECT rec, id, regexp_extract_all({_LOWER.format('text')},'[\p{{L}}\p{{N}}]+') AS w FROM r), s AS (SELECT DISTINCT rec, id, unnest(list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) AS g FROM w WHERE len(w)>=20),
 n AS (SELECT rec, id, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT a.rec, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.rec=b.rec AND a.g=b.g AND a.id<b.id GROUP BY ALL)
 SELECT p.rec, id_a, id_b FROM p JOIN n x ON x.rec=p.rec AND x.id=id_a JOIN n y ON y.rec=p.rec AND y.id=id_b WHERE c>=0.6*(x.n+y.n-c)""",
    "p6_found": rf"""WITH l AS (SELECT chunk_id, project, source_path, {_LINES} AS ls FROM chunks WHERE text IS NOT NULL), t AS (SELECT chunk_id, project, source_path, i-1 AS line_no, ls[i] AS t FROM l, LATERAL (SELECT unnest(range(1,len(ls)+1)) AS i)),
 f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({_LOWER.format('t')},'{_WS}+',' ','g'),'\p{{Nd}}+','0','g'),'^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$','','g') AS f FROM t),
 k AS (SELECT project, f FROM f WHERE length(f)>=12 GROUP BY ALL HAVING count(DISTINCT source_path)>=5) SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM f JOIN k USING (project, f)""",
}
