"""Search marts: projections of merged records (finalized_id, cluster_id, d) for semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents


def marts(finalized: DataFrame, converted: DataFrame, clusters: DataFrame, today: Column, prefix: str = "") -> dict[str, DataFrame]:
    """The eight marts by name; ``prefix`` is cut off output types. Each reads the fields that it needs and nothing else."""
    d, rows = F.col("d"), finalized
    each = lambda values, name="value": rows.select("finalized_id", F.explode(values).alias(name))
    single = rows.select(
        "finalized_id", documents.publication_year(d).alias("yr"), documents.content_marking(d).alias("content_marking"), documents.search_status(d).alias("publication_status"),
        documents.level(d).isNotNull().cast("int").alias("swedish_list"), documents.open_access(d, today).cast("int").alias("open_access"), documents.autoclassified(d).cast("int").alias("autoclassified"), documents.in_doaj(d).cast("int").alias("doaj"),
    )
    orgs = rows.select("finalized_id", "cluster_id").join(clusters, "cluster_id").join(converted.select(F.col("id").alias("converted_id"), "source"), "converted_id")
    people = each(documents.creators(d), "c").select("finalized_id", "c.orcid", "c.family_name", "c.given_name", "c.local_id", "c.local_id_by")
    return {
        "search_single": single, "search_doi": each(documents.identifiers(d, "DOI")),
        "search_genre_form": each(F.transform(documents.output_types(d), lambda g: F.when(g.startswith(prefix), F.substring(g, F.lit(len(prefix) + 1), F.length(g))).otherwise(g))),
        "search_subject": each(documents.subjects(d)), "search_creator": people, "search_org": orgs.select("finalized_id", F.col("source").alias("value")).distinct(),
        "search_fulltext": rows.select("finalized_id", documents.title(d).alias("title"), F.array_join(documents.keywords(d), " ").alias("keywords")), "search_body": rows.select("finalized_id", F.to_json(d).alias("data")),
    }
