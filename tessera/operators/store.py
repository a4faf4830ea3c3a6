"""Keyed-table maintenance without MERGE: upserts, replacements, cascades, diffs, ledgers, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones on key; columns in keep stay from the old row; lifecycle says what happened."""
    o, n = old.alias("o"), new.alias("n")
    has_o, has_n = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(has_n, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
    state = F.when(has_o & has_n, "replaced").when(has_n, "added").otherwise("kept").alias("lifecycle")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c) for c in old.columns], state)


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of each group that new has are replaced by new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def cascade_delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges(src, dst) that touch no id of gone(id) on either end."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")


def catchup_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: CREATED, MODIFIED or DELETED between two states."""
    b = before.select(key, F.col(digest).alias("was"))
    a = after.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "CREATED").when(F.col("now").isNull(), "DELETED").when(F.col("was") != F.col("now"), "MODIFIED")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def symmetric_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    gone = before.subtract(after).withColumn("side", F.lit("removed"))
    return gone.unionByName(after.subtract(before).withColumn("side", F.lit("added")))


def ledger_recall(units: DataFrame, ledger: DataFrame) -> DataFrame:
    """units(unit, name, hash), ledger(name, hash, summary, at): fresh by hash, else stale by the latest of the name, else missing. Of one time the greater summary counts."""
    newest = F.max_by("summary", F.struct("at", "summary"))
    exact = ledger.groupBy("hash").agg(newest.alias("exact"))
    latest = ledger.groupBy("name").agg(newest.alias("latest"))
    j = units.join(exact, "hash", "left").join(latest, "name", "left")
    state = F.when(F.col("exact").isNotNull(), "fresh").when(F.col("latest").isNotNull(), "stale").otherwise("missing")
    return j.select("unit", state.alias("state"), F.coalesce("exact", "latest").alias("summary"))


def impact_set(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """id, reason: changed ids and what depends on them directly."""
    direct = changed.select("id").distinct().withColumn("reason", F.lit("changed"))
    dep = edges.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return direct.unionByName(dep.join(direct.select("id"), "id", "left_anti").withColumn("reason", F.lit("dependent")))


def keep_newest(rows: DataFrame, order: list, n: int = 50) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def latest_by_key(rows: DataFrame, key: str, value: str, at: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias(value))


def is_changed(current: Column, stored: Column) -> Column:
    """A content hash counts as changed if none is stored or it differs."""
    return (F.coalesce(stored, F.lit("")) == "") | (stored != current)


def classify_changes(changes: DataFrame) -> DataFrame:
    """changes(path, excluded, is_binary, language) with its class: excluded, binary, unsupported or candidate, the first that holds."""
    kind = F.when(F.col("excluded"), "excluded").when(F.col("is_binary"), "binary").when(F.col("language").isNull(), "unsupported").otherwise("candidate")
    return changes.withColumn("class", kind)


def replace_by_file(old: DataFrame, new: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """(rows after all rows of new's files are replaced, file with the numbers removed and written)."""
    touched = new.select(file).distinct()
    removed = old.join(touched, file, "left_semi").groupBy(file).agg(F.count("*").alias("removed"))
    written = new.groupBy(file).agg(F.count("*").alias("written"))
    counts = written.join(removed, file, "left").select(file, F.coalesce("removed", F.lit(0)).cast("long").alias("removed"), "written")
    return replace_groups(old, new, file), counts


def store_bundles(files: DataFrame, symbols: DataFrame, edges: DataFrame, new_files: DataFrame, new_symbols: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(path, hash), symbols(id, path), edges(src, dst) after new bundles come in.

    A bundle whose hash is stored already changes nothing; else the file's symbols go, with every edge that touches
    one of them, and the bundle's rows come.
    """
    known = files.select("path", F.col("hash").alias("stored"))
    fresh = new_files.join(known, "path", "left").where(is_changed(F.col("hash"), F.col("stored"))).drop("stored")
    paths = fresh.select("path")
    gone = symbols.join(paths, "path", "left_semi").select("id")
    kept = new_symbols.join(paths, "path", "left_semi")
    added = new_edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    return (
        replace_groups(files, fresh.select(files.columns), "path"),
        symbols.join(paths, "path", "left_anti").unionByName(kept),
        cascade_delete(edges.select("src", "dst"), gone).unionByName(added).distinct(),
    )


def remove_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, file) and edges(src, dst) without the nodes of the files gone(file)."""
    lost = nodes.join(gone, "file", "left_semi").select("id")
    return nodes.join(gone, "file", "left_anti"), cascade_delete(edges, lost)


def last_metadata(edges: DataFrame, order: str) -> DataFrame:
    """One row a (src, dst, type); the metadata of the last by ``order`` stays, of equal ones the greater as text."""
    return edges.groupBy("src", "dst", "type").agg(F.max_by("metadata", F.struct(F.col(order), F.col("metadata").cast("string").alias("text"))).alias("metadata"))


def next_sequence(existing: DataFrame, new: DataFrame, value: str, order: list) -> DataFrame:
    """new with numbers from the greatest ``value`` of existing on (from 1 in an empty table), in order within conv_id."""
    last = existing.groupBy("conv_id").agg(F.max(value).alias("last"))
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(*order))
    return new.join(last, "conv_id", "left").withColumn(value, (F.coalesce("last", F.lit(0)) + r).cast("long")).drop("last")


def removed_pages(previous: DataFrame, current: list[DataFrame]) -> DataFrame:
    """page ids of previous(page) that none of the current sets has."""
    every = current[0].select("page")
    for c in current[1:]:
        every = every.unionByName(c.select("page"))
    return previous.select("page").distinct().join(every.distinct(), "page", "left_anti")


def referrers(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """manifest(page, links array) -> pages that link to a removed page and stay themselves."""
    link = manifest.select("page", F.explode("links").alias("target")).join(removed.select(F.col("page").alias("target")), "target", "left_semi")
    return link.select("page").distinct().join(removed, "page", "left_anti")


def regeneration_flags(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous(page, kind, title, template), current the same -> one row: whether navigation, the diagrams' index or everything has to be made anew."""
    j = previous.select("page", F.col("kind").alias("pk"), F.col("title").alias("pt"), F.col("template").alias("pf")).join(current, "page", "full_outer")
    moved = F.col("pk").isNull() | F.col("kind").isNull()
    kind = F.coalesce("kind", "pk")
    tree = kind.isin("module", "feature") & moved | ((kind == "feature") & ~moved & (F.col("pt") != F.col("title")))
    index = moved & kind.isin("module", "sequence-diagram", "class-diagram", "use-case-diagram")
    return j.agg(F.coalesce(F.bool_or(tree), F.lit(False)).alias("navigation"), F.coalesce(F.bool_or(index), F.lit(False)).alias("diagrams"), F.coalesce(F.bool_or(F.col("pf") != F.col("template")), F.lit(False)).alias("everything"))


def pages_in_target(pages: DataFrame, impact: DataFrame, everything: bool) -> DataFrame:
    """The pages that a selective run makes: all, or those of impact(page)."""
    return pages if everything else pages.join(impact.select("page").distinct(), "page", "left_semi")


def content_gated(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows of new(key, content) whose content's hash is not the stored(key, hash) one: what has to be written."""
    hashed = new.withColumn("hash", F.sha2("content", 256))
    return hashed.join(stored.select(key, F.col("hash").alias("was")), key, "left").where(is_changed(F.col("hash"), F.col("was"))).drop("was")


def compute_misses(units: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """units(unit, hash, text) with value and source: from cache(hash, value), else by compute(text column).

    Only misses are computed; a unit whose computation gives null keeps its row, with source 'failed'.
    """
    known = cache.groupBy("hash").agg(F.max("value").alias("value"))
    hit = units.join(known, "hash").withColumn("source", F.lit("cache"))
    miss = units.join(known.select("hash"), "hash", "left_anti").withColumn("value", compute(F.col("text")))
    return hit.unionByName(miss.withColumn("source", F.when(F.col("value").isNull(), "failed").otherwise("computed")))


def narrative_state(requests: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """requests(repo, key, fingerprint), cache(repo, key, fingerprint, text, at), answers(repo, text) -> repo, state, text.

    The stored text of the same prompt; else the model's answer; else the latest stored text of the repository, as
    'previous-prompt' where the repository is the one it described and as 'stale' where it is not; else 'none'.
    """
    hit = cache.groupBy("repo", "key").agg(F.max_by("text", F.struct("at", "text")).alias("hit"))
    latest = cache.groupBy("repo").agg(F.max_by(F.struct("text", "fingerprint"), F.struct("at", "text", "fingerprint")).alias("last"))
    j = requests.join(hit, ["repo", "key"], "left").join(answers.select("repo", F.col("text").alias("answer")), "repo", "left").join(latest, "repo", "left")
    same = F.coalesce(F.col("last.fingerprint") == F.col("fingerprint"), F.lit(False))
    state = F.when(F.col("hit").isNotNull(), "cached").when(F.col("answer").isNotNull(), "generated").when(F.col("last").isNull(), "none").when(same, "previous-prompt").otherwise("stale")
    return j.select("repo", state.alias("state"), F.coalesce("hit", "answer", "last.text").alias("text"))


def plan_state(requests: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """requests(repo, key), cache(key, plan), answers(repo, plan) -> repo, source (cache, call or none) and plan. A cache without the key costs a call, never the run."""
    stored = cache.where("plan is not null").groupBy("key").agg(F.max("plan").alias("stored"))
    j = requests.join(stored, "key", "left").join(answers.select("repo", F.col("plan").alias("answer")), "repo", "left")
    source = F.when(F.col("stored").isNotNull(), "cache").when(F.col("answer").isNotNull(), "call").otherwise("none")
    return j.select("repo", source.alias("source"), F.coalesce("stored", "answer").alias("plan"))


def carry_forward(previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of a fresh build, and the previous build's rows of keys that it lacks."""
    return insert_or_ignore(fresh, previous.select(fresh.columns), key)


def fingerprint(files: DataFrame, by: str, lead: str = "") -> DataFrame:
    """files(by, path, hash) -> by, fingerprint: sha1 over lead and the sorted (path, hash) lines of each group."""
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit("\0"), "hash", F.lit("\n"))))
    return files.groupBy(by).agg(F.sha1(F.concat(F.lit(lead + "\0"), F.array_join(lines, ""))).alias("fingerprint"))


def variants(base: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """base(id, kind, name) with its variant's columns: parent of classes(id, parent), returns and n_parameters of functions(id, returns, n_parameters); defaults where it has none."""
    j = base.join(classes, "id", "left").join(functions, "id", "left")
    return j.select("id", "kind", "name", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("returns", F.lit("")).alias("returns"), F.coalesce("n_parameters", F.lit(0)).alias("n_parameters"))


def bundles(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """files(path, hash), symbols(id, path), edges(src, dst) -> path, hash, symbols (sorted ids), n_edges that leave them. One row a file."""
    out = symbols.select(F.col("id").alias("src"), "path").join(edges, "src").groupBy("path").agg(F.count("*").alias("n_edges"))
    own = symbols.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("symbols"))
    none = F.array().cast("array<string>")
    return files.join(own, "path", "left").join(out, "path", "left").select("path", "hash", F.coalesce("symbols", none).alias("symbols"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def stage_durations(rows: DataFrame, group: str, at: str) -> DataFrame:
    nxt = F.lead(at).over(W.partitionBy(group).orderBy(at, "event_id"))
    return rows.withColumn("seconds", (F.unix_timestamp(nxt.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))))
