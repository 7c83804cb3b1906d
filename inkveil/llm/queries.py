"""Registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from . import licences, media, merkle, mixing, neighbours, oracles, packing, quality, repair, simhash, sitetree, substrings, tokenize
from .common import table


def op1_suffix_dedup(spark, sf_dir):
    return substrings.dedup_bytes(table(spark, sf_dir, "documents"))


def op2_neighbours(spark, sf_dir):
    return neighbours.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op3_flac(spark, sf_dir):
    return media.round_trip(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substrings.dedup_words(table(spark, sf_dir, "documents"))


def op5_licences(spark, sf_dir):
    return licences.licence_digest(table(spark, sf_dir, "documents"))


def op6_site_tree(spark, sf_dir):
    return sitetree.main_text(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark, sf_dir):
    return tokenize.token_digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repair(spark, sf_dir):
    return repair.repair_digest(table(spark, sf_dir, "conversations"))


def op12_merkle(spark, sf_dir):
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op13_mixing(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_neighbours, op3_flac, op4_substring_dedup, op5_licences, op6_site_tree,
        op7_byte_bpe, op8_simhash, op9_packing, op10_quality, op11_repair, op12_merkle, op13_mixing,
    )
}
#: Operators 4 and 11 to 13 can be said in SQL.  The others are held against brute force in tests.
ORACLES: dict[str, str] = {
    "op11_repair": oracles.REPAIR,
    "op12_merkle": oracles.MERKLE,
    "op13_mixing": oracles.MIXING,
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM d),
v AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
hit AS (SELECT DISTINCT v.doc_id, v.i + o.o AS pos FROM v JOIN f USING (k) CROSS JOIN (SELECT unnest(range(13)) AS o) o WHERE f.first < v.doc_id),
t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.pos) AS text FROM t ANTI JOIN hit ON hit.doc_id = t.doc_id AND hit.pos = t.pos GROUP BY t.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
