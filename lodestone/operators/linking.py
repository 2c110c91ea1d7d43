"""Identity links: every check that fails is a reason, and no reason means accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import blank_to_null, last_segment, official_site, same_site, stable_id


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold (unknown counts as failing), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def decided(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Every row with its reasons and the decision: rejected rows stay as an audit."""
    return df.withColumn("reasons", reasons(checks)).withColumn("accepted", F.size("reasons") == 0)


def verify_institutions(candidates: DataFrame) -> DataFrame:
    """Candidates (organization_id, organization_name, local_id, local_name, openalex_id,
    display_name, ror, type, homepage_domains, wikidata, entity struct of id, display_name,
    ror, homepage_url, type, ids) against the retrieved record. local_id and local_name are
    what was reviewed, organization_* what the catalog has now."""
    e = lambda p: F.col(f"entity.{p}")
    qid = last_segment(F.rtrim(e("ids.wikidata"), F.lit("/")))
    return decided(candidates, {
        "local id": F.col("organization_id") == F.col("local_id"), "local name": F.col("organization_name") == F.col("local_name"),
        "id": (e("id") == F.col("openalex_id")) & (e("ids.openalex") == F.col("openalex_id")), "name": e("display_name") == F.col("display_name"), "type": e("type") == F.col("type"),
        "ror": (e("ror") == F.col("ror")) & (e("ids.ror") == F.col("ror")), "homepage": F.exists("homepage_domains", lambda d: same_site(e("homepage_url"), d)),
        "wikidata": blank_to_null("wikidata").isNull() | (qid == F.col("wikidata")),
    })


def current_claims(claims: Column) -> Column:
    """Values of claims that are not deprecated."""
    return F.transform(F.filter(claims, lambda c: F.coalesce(c["rank"], F.lit("normal")) != "deprecated"), lambda c: c["value"])


def verify_items(candidates: DataFrame) -> DataFrame:
    """Candidates (local_id, local_name, local_kind, locals array of (id, name), qid, names,
    entity_kind, instance_of, websites, entity struct of id, labels, aliases, p31, p856)
    against the retrieved item. The local record must be one that was reviewed, by id and
    name; a label or an alias must be a reviewed name; the site must match by host, and where
    a product shares its host, by path."""
    names = F.concat(*(F.coalesce(F.col(f"entity.{c}"), F.array().cast("array<string>")) for c in ("labels", "aliases")))
    return decided(candidates, {
        "local": F.exists("locals", lambda x: (x["id"] == F.col("local_id")) & (x["name"] == F.col("local_name"))), "kind": F.col("local_kind") == F.col("entity_kind"),
        "id": F.col("entity.id") == F.col("qid"), "name": F.arrays_overlap("names", names), "instance": F.arrays_overlap("instance_of", current_claims(F.col("entity.p31"))),
        "website": F.exists(current_claims(F.col("entity.p856")), lambda s: F.exists("websites", lambda w: official_site(s, w))),
        "evidence": F.col("entity").isNotNull(),
    })


def back_links(response: DataFrame, prefix: str) -> DataFrame:
    """Entities of a query response (`bindings` array) under a namespace."""
    return response.select(F.explode("bindings").alias("b")).select(F.col("b.entity.value").alias("entity")).where(F.col("entity").startswith(prefix)).distinct()


def safe_name(path: Column) -> Column:
    """Whether a stored file name stays in its folder."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), F.lit("..")) & (path != "")


def replay_evidence(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest rows (file, sha256, ...) with the reasons their stored bytes don't support
    them; blobs: (file, content)."""
    stored = blobs.select("file", F.sha2("content", 256).alias("__found"))
    both = manifest.join(stored, "file", "left")
    return decided(both, {"path": safe_name(F.col("file")), "present": F.col("__found").isNotNull(), "checksum": F.col("__found") == F.col("sha256")}).drop("__found")


def link_records(accepted: DataFrame) -> DataFrame:
    """Evidence rows for accepted links (subject, target, source_url, sha256, retrieved_at, reason)."""
    return accepted.withColumn("id", F.concat(F.lit("link/"), stable_id("subject", "target", "source_url"))).withColumn("source_url", blank_to_null("source_url")).dropDuplicates(["id"])


def pair_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that are in one set only, and in which: empty means the sets are equal."""
    a, b = left.distinct(), right.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def verified_cards(cards: DataFrame, manifest: DataFrame, publishers: list[str]) -> DataFrame:
    """Model cards (url, id, ...) whose URL the manifest knows for that repository id and
    whose publisher is allowed."""
    known = manifest.select("url", F.col("id").alias("__id"))
    return cards.join(known, "url").where((F.col("id") == F.col("__id")) & F.split_part("id", F.lit("/"), F.lit(1)).isin(publishers)).drop("__id")
