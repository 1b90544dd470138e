"""Queries of the corpus operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from mnemo.llm import centroids, decontamination, fingerprints, matroska, minhash_dedup, packing, prefix_trie, secrets, sharding, suffix_dedup, token_files, toxicity, warc
from mnemo.llm.common import scratch_path, table

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_sharding", sharding.SQL)
def op1(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op8_decontamination", decontamination.SQL)
def op8(spark, sf_dir):
    return decontamination.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op5_minhash_dedup")
def op5(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op10_matroska")
def op10(spark, sf_dir):
    return matroska.describe(matroska.to_media(table(spark, sf_dir, "documents")))


@query("media_packets")
def media_packets(spark, sf_dir):
    return matroska.packet_digests(matroska.to_media(table(spark, sf_dir, "documents")))


@query("op7_warc", warc.SQL)
def op7(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("url")


@query("op9_secrets")
def op9(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op4_token_files")
def op4(spark, sf_dir):
    return token_files.through_files(table(spark, sf_dir, "documents"))


@query("op11_centroids", centroids.SQL)
def op11(spark, sf_dir):
    return centroids.describe(spark, table(spark, sf_dir, "embeddings"))


@query("op12_fingerprints")
def op12(spark, sf_dir):
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", prefix_trie.SQL)
def op13(spark, sf_dir):
    return prefix_trie.describe(table(spark, sf_dir, "conversations"))
