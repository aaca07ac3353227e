"""Clusters of addresses that were inputs of one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.attribution import best_attribution
from ledgerspark.operators.graph import spenders
from ledgerspark.session import materialize


def co_input_edges(inputs: DataFrame) -> DataFrame:
    """K1: each input address tied to the smallest one of its transaction (n - 1 edges, not n squared)."""
    members = spenders(inputs).where("txid IS NOT NULL").withColumn("hub", F.min("address").over(Window.partitionBy("txid")))
    return members.where(F.col("address") != F.col("hub")).select("address", "hub").distinct()


def cio_clusters(inputs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """K2: (address, cluster_id), the cluster named by its smallest address.

    Connected components by the FastSV scheme (Zhang, Azad, Buluc 2020): parents point to
    ever smaller addresses, hooking whole trees at once, so the number of rounds grows
    with the logarithm of the component size. ``parent``, ``top`` = parent of the parent.
    """
    edges = co_input_edges(inputs) if edges is None else edges
    both = edges.select(F.col("address").alias("u"), F.col("hub").alias("v"))
    both = materialize(both.union(both.select("v", "u")), "links")
    nodes = spenders(inputs).select(F.col("address").alias("u")).distinct()
    state = materialize(nodes.select("u", F.col("u").alias("parent"), F.col("u").alias("top")), "clusters")
    while True:
        near = (
            both.join(state.select(F.col("u").alias("v"), "top"), "v")
            .groupBy("u").agg(F.min("top").alias("low"))
        )
        hooked = state.join(near, "u", "left")
        # Every node proposes for itself and for its parent; the smallest proposal wins.
        own = hooked.select("u", F.least("parent", "top", "low").alias("parent"), F.col("top").alias("old_top"))
        up = hooked.where(F.col("low") < F.col("parent")).groupBy(F.col("parent").alias("u")).agg(
            F.min("low").alias("parent")).withColumn("old_top", F.lit(None).cast("string"))
        parents = own.unionByName(up).groupBy("u").agg(
            F.min("parent").alias("parent"), F.max("old_top").alias("old_top"))
        parents = materialize(parents, "parents")
        grand = parents.select(F.col("u").alias("parent"), F.col("parent").alias("top"))
        moved = materialize(
            parents.join(grand, "parent").select("u", "parent", "top", (F.col("top") != F.col("old_top")).alias("moved")),
            "clusters")
        state = moved.select("u", "parent", "top")
        if moved.where("moved").isEmpty():
            return state.select(F.col("u").alias("address"), F.col("top").alias("cluster_id"))


def cluster_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("address_count"))


def cio_evidence(inputs: DataFrame, membership: DataFrame) -> DataFrame:
    """K3: per transaction and cluster how many addresses it merged, over how many inputs.

    The members themselves stay rows, see :func:`cio_evidence_members`: one transaction may
    merge more addresses than fit one array.
    """
    return (
        spenders(inputs).join(membership, "address").groupBy("txid", "cluster_id", "address")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("txid", "cluster_id")
        .agg(F.count(F.lit(1)).alias("merged_count"), F.sum("n").alias("input_count"))
        .where(F.col("merged_count") > 1)
    )


def cio_evidence_members(inputs: DataFrame, membership: DataFrame) -> DataFrame:
    """K3, members: the merged addresses of every evidence row."""
    evidence = cio_evidence(inputs, membership).select("txid", "cluster_id")
    return (
        spenders(inputs).distinct().join(membership, "address")
        .join(evidence, ["txid", "cluster_id"], "left_semi").select("txid", "cluster_id", "address")
    )


def attribute_clusters(membership: DataFrame, attributions: DataFrame, sources: DataFrame) -> DataFrame:
    """K4: each cluster with size and the label of its best-known member (our order: priority, level, address)."""
    best = best_attribution(attributions, sources)
    body = F.struct("priority", "confidence_level", "address", "entity_name", "entity_type", "source_key")
    labels = membership.join(best, "address").groupBy("cluster_id").agg(F.min(body).alias("best"))
    return cluster_sizes(membership).join(labels, "cluster_id", "left").select(
        "cluster_id", "address_count", "best.entity_name", "best.entity_type",
        F.col("best.source_key").alias("attribution_source"), "best.confidence_level")


def cluster_id_of(addresses: DataFrame, membership: DataFrame) -> DataFrame:
    """K5: cluster of each address, NULL when unknown."""
    return addresses.join(membership, "address", "left")


def first_seen_txid(inputs: DataFrame, transactions: DataFrame) -> DataFrame:
    """K6: the first transaction that spent from each address."""
    when = transactions.select("txid", "block_height")
    return (
        spenders(inputs).join(when, "txid").groupBy("address")
        .agg(F.min(F.struct("block_height", "txid"))["txid"].alias("first_seen_txid"))
    )
