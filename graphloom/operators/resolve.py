"""References to edges: each intent is resolved against the known entities, as joins on candidate names.

Candidates of an intent are (priority, name) pairs, exploded once, joined once to one row per name, and the best priority is kept; only
what is still open goes on to the containment match and to the match by bare name. One row per name is built before any join, so a name
that many entities share multiplies nothing, and names are looked up once, however many intents share them. Picks among equals are
fixed: own repository first, then file, line, uuid.

What an intent may mean is either all entities given (`repo`, if given, only comes first), or, with `contexts` (repo_name, context_repo),
those of its own repository and of the repositories that it depends on: then one job resolves many repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import capitalised, last_segment, starts_upper
from graphloom.schema import RELATION
from graphloom.session import cut

#: Letters of a method's name by which the containment match is joined, at most.
HEAD = 8


def relation(intent_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RELATION.items() for x in kv]), intent_type)


def _order() -> list[Column]:
    return [F.coalesce("file_path", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(0)).alias("l"), F.col("uuid").alias("u")]


def _pick(entities: DataFrame, key: str, repo: str | None) -> DataFrame:
    """(key, uuid): the entity that stands for each value of `key`."""
    own = (F.col("repo_name") != repo) if repo is not None else F.lit(False)
    return entities.where(F.col(key).isNotNull() & F.col("uuid").isNotNull()).groupBy(key).agg(F.min_by("uuid", F.struct(own.alias("o"), *_order())).alias("uuid"))


def fqn_map(entities: DataFrame, repo: str | None = None) -> DataFrame:
    e = entities.withColumn("key", F.coalesce("fqn", "name"))
    return _pick(e, "key", repo)


def name_map(entities: DataFrame, repo: str | None = None) -> DataFrame:
    return _pick(entities.withColumn("key", F.col("name")), "key", repo)


def context(entities: DataFrame, repo: str, dependencies: list[str]) -> DataFrame:
    """The entities that references of `repo` may mean: its own and those of the repositories it depends on."""
    return entities.where(F.col("repo_name").isin(repo, *dependencies))


def _repo(df: DataFrame) -> Column:
    return F.coalesce("repo_name", F.lit("")) if "repo_name" in df.columns else F.lit("")


class _Known:
    """The entities by name, for the scopes of intents."""

    def __init__(self, entities: DataFrame, repo: str | None, contexts: DataFrame | None):
        self.entities, self.repo = entities.withColumn("of", _repo(entities)), repo
        self.contexts = None
        if contexts is not None:
            self.contexts = contexts.select(F.col("repo_name").alias("scope"), F.col("context_repo").alias("of")).where("scope <> of").distinct()

    def scope(self, intents: DataFrame) -> Column:
        return _repo(intents) if self.contexts is not None else F.lit("")

    def names(self, key: Column) -> DataFrame:
        """(of, key, at): one row per repository and name, or per name alone without contexts."""
        e = self.entities.withColumn("key", key).where("key is not null and uuid is not null")
        own = (F.col("of") != self.repo) if self.repo is not None else F.lit(False)
        of = F.col("of") if self.contexts is not None else F.lit("")
        return e.groupBy(of.alias("of"), "key").agg(F.min(F.struct(own.alias("o"), *_order())).alias("at"))

    def spread(self, wanted: DataFrame) -> DataFrame:
        """`wanted` (scope, ...) for every repository `of` that its scope may mean."""
        if self.contexts is None:
            return wanted.withColumn("of", F.lit(""))
        return wanted.withColumn("of", F.col("scope")).unionByName(wanted.join(self.contexts, "scope"))

    def look_up(self, wanted: DataFrame, key: Column) -> DataFrame:
        """(scope, key, uuid) of the distinct (scope, key) of `wanted` that some entity bears."""
        w = self.spread(wanted.select("scope", "key").where("key is not null").distinct())
        got = w.join(self.names(key), ["of", "key"])
        return got.groupBy("scope", "key").agg(F.min(F.struct((F.col("of") != F.col("scope")).alias("far"), "at")).alias("m")).select("scope", "key", F.col("m.at.u").alias("uuid"))


def tidy_path(path: Column) -> Column:
    """The path without `.` and `..`."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def resolve(intents: DataFrame, entities: DataFrame, repo: str | None = None, fuzzy: bool = True, contexts: DataFrame | None = None) -> DataFrame:
    """Edges (src_uuid, dst_uuid, rel_type), each once; `intents` has src_uuid, src_file, src_enclosing_class, intent_type, target, receiver.

    Null targets and sources resolve to nothing. An intent that matches nothing is dropped. A path is one of the intent's own repository.
    """
    known = _Known(entities, repo, contexts)
    plain = intents.where(~F.col("intent_type").isin("Call", "HtmlFileImport", "CssFileImport")).select(known.scope(intents).alias("scope"), F.col("target").alias("key"), "src_uuid", relation(F.col("intent_type")).alias("rel_type")).where("key is not null")
    plain = plain.distinct().join(known.look_up(plain, F.col("name")), ["scope", "key"]).select("src_uuid", F.col("uuid").alias("dst_uuid"), "rel_type")
    files = known.entities.groupBy("of", F.col("file_path").alias("key")).agg(F.min_by("uuid", F.struct(F.coalesce("start_line", F.lit(0)), "uuid")).alias("uuid"))
    imports = intents.where(F.col("intent_type").isin("HtmlFileImport", "CssFileImport")).withColumn("of", _repo(intents))
    absolute = tidy_path(F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(F.regexp_replace("src_file", "[^/]*$", ""), F.col("target"))))
    imports = imports.withColumn("key", absolute).join(files, ["of", "key"]).select("src_uuid", F.col("uuid").alias("dst_uuid"), relation(F.col("intent_type")).alias("rel_type"))
    calls = resolve_calls(intents, entities, repo, fuzzy, contexts).select("src_uuid", F.col("uuid").alias("dst_uuid"), F.lit("CALLS").alias("rel_type"))
    return plain.unionByName(imports).unionByName(calls).where("src_uuid is not null and dst_uuid is not null").distinct()


def parents(intents: DataFrame, entities: DataFrame, by_repo: bool = False) -> DataFrame:
    """(cls, parent, n): direct parents of each class name, in the order of its Extends references; `by_repo` adds scope, the class's repository."""
    scope = _repo(entities) if by_repo else F.lit("")
    e = entities.select(F.col("uuid").alias("src_uuid"), F.col("name").alias("cls"), scope.alias("scope"))
    p = intents.where("intent_type = 'Extends' and target is not null").select("src_uuid", "target", "seq").join(e, "src_uuid")
    return p.groupBy(*(["scope"] if by_repo else []), "cls", F.col("target").alias("parent")).agg(F.min("seq").alias("n"))


def _contained(open_calls: DataFrame, known: _Known, dotted) -> DataFrame:
    """(scope, rc, method, uuid): the dotted name that contains receiver and method, for the distinct pairs of `open_calls`.

    A match holds the method's first part at the start of a segment and the receiver's last letter before the dot: segments are cut to
    their first 1 to HEAD letters, so that whole short names and heads of long ones are equal keys of a join. Where one head is very
    common, the join is split by adaptive execution.
    """
    first = F.element_at(F.split("method", r"\."), 1)
    pairs = open_calls.where("rc <> '' and method <> ''").select("scope", "rc", "method").distinct()
    pairs = known.spread(pairs).withColumn("head", F.substring(first, 1, HEAD)).withColumn("whole", F.least(F.length(first), F.lit(HEAD))).withColumn("edge", F.lower(F.substring("rc", -1, 1)))
    parts = F.split("key", r"\.")
    dots = known.names(F.coalesce("fqn", "name")).where(F.instr("key", ".") > 0).select("of", "key", "at")
    segment = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda s, i: F.struct(s.alias("s"), F.lower(F.substring(F.element_at(parts, i + 1), -1, 1)).alias("edge")))
    ends = dots.select("of", "key", "at", F.explode(segment).alias("p")).select("of", "key", "at", "p.*")
    ends = ends.where("s <> ''").select("of", "key", "at", "edge", F.explode(F.sequence(F.lit(1), F.least(F.length("s"), F.lit(HEAD)))).alias("whole"), "s").withColumn("head", F.expr("substring(s, 1, whole)"))
    ends = ends.select("of", "key", "at", "edge", "whole", "head").distinct()
    hit = pairs.join(ends, ["of", "head", "whole", "edge"]).where(F.contains("key", dotted(F.col("rc"))) | F.contains("key", dotted(capitalised(F.col("rc")))))
    return hit.groupBy("scope", "rc", "method").agg(F.min(F.struct((F.col("of") != F.col("scope")).alias("far"), "key", F.col("at.u").alias("u"))).alias("m")).select("scope", "rc", "method", F.col("m.u").alias("uuid"))


def resolve_calls(intents: DataFrame, entities: DataFrame, repo: str | None = None, fuzzy: bool = True, contexts: DataFrame | None = None) -> DataFrame:
    """The distinct call intents with `uuid`, what they call, and `step`, the rule that found it; unresolved ones are left out.

    Steps: 1 the enclosing class, 2 its parents (for self), 3 the receiver as a class, 4 and 5 the receiver's last part as it is and
    capitalised, 6 (if `fuzzy`) any name that contains one of those and the method, 7 the same file of the same repository, 8 any entity
    of that name. A receiver whose last part is empty takes no part in step 6. Building the result runs two jobs.
    """
    known = _Known(entities, repo, contexts)
    c = intents.where("intent_type = 'Call' and target is not null and src_uuid is not null")
    c = c.select("src_uuid", "src_file", known.scope(intents).alias("scope"), _repo(intents).alias("of"), F.col("src_enclosing_class").alias("cls"), F.col("target").alias("method"), "receiver").distinct()
    own = F.col("receiver").isNull() | F.col("receiver").isin("this", "self")
    rc = last_segment(F.col("receiver"))
    dotted = lambda a: F.concat(a, F.lit("."), F.col("method"))
    key = ["src_uuid", "src_file", "scope", "of", "cls", "method", "receiver"]
    lineage = parents(intents, entities, contexts is not None)
    lineage = lineage.groupBy(*[x for x in ("scope", "cls") if x in lineage.columns]).agg(F.array_sort(F.collect_list(F.struct("n", "parent"))).alias("up"))
    c = c.join(lineage, [x for x in ("scope", "cls") if x in lineage.columns], "left")
    inherited = F.when(F.col("receiver") == "self", F.transform("up", lambda p, i: F.struct((i + 100).alias("p"), F.concat(p["parent"], F.lit("."), F.col("method")).alias("fqn"), F.lit(2).alias("step"))))
    one = lambda p, cond, fqn, step: F.when(cond, F.array(F.struct(F.lit(p).alias("p"), fqn.alias("fqn"), F.lit(step).alias("step"))))
    none = F.array().cast("array<struct<p:int,fqn:string,step:int>>")
    tries = F.concat(*[
        F.coalesce(x.cast("array<struct<p:int,fqn:string,step:int>>"), none)
        for x in (
            one(1, own & F.col("cls").isNotNull(), dotted(F.col("cls")), 1), inherited, one(1_000_000, starts_upper(F.col("receiver")), dotted(F.col("receiver")), 3),
            one(1_000_001, F.col("receiver").isNotNull(), dotted(rc), 4), one(1_000_002, F.col("receiver").isNotNull(), dotted(capitalised(rc)), 5),
        )
    ])
    rows = c.select(*key, F.explode_outer(tries).alias("t")).select(*key, "t.p", F.col("t.fqn").alias("key"), "t.step")
    wanted = known.look_up(rows, F.coalesce("fqn", "name"))
    # calls without a candidate stay out of the join: a null key would bring them all to one task
    tried = rows.where("key is not null").join(wanted, ["scope", "key"], "left").select(*key, "p", "step", "uuid")
    tried = tried.unionByName(rows.where("key is null").select(*key, "p", "step", F.lit(None).cast("string").alias("uuid")))
    # what follows reads these rows many times: written once, else each reader would plan all joins before it again
    got = cut(tried.groupBy(*key).agg(F.min_by(F.struct("uuid", "step"), F.when(F.col("uuid").isNotNull(), F.col("p"))).alias("r")))
    found = got.where("r.uuid is not null").select(*key, "r.uuid", "r.step")
    still = got.where("r.uuid is null").select(*key)
    if fuzzy:
        with_rc = still.where("receiver is not null").withColumn("rc", rc)
        j = cut(with_rc.join(_contained(with_rc, known, dotted), ["scope", "rc", "method"], "left"))
        found = found.unionByName(j.where("uuid is not null").select(*key, "uuid", F.lit(6).alias("step")))
        still = still.where("receiver is null").unionByName(j.where("uuid is null").select(*key))
    same = known.entities.where("name is not null").groupBy("of", F.col("name").alias("method"), F.col("file_path").alias("src_file")).agg(F.min_by("uuid", F.struct(F.coalesce("start_line", F.lit(0)), "uuid")).alias("here"))
    named = known.look_up(still.withColumn("key", F.col("method")), F.col("name")).select("scope", F.col("key").alias("method"), F.col("uuid").alias("there"))
    last = still.join(same, ["of", "method", "src_file"], "left").join(named, ["scope", "method"], "left").where("there is not null")
    last = last.select(*key, F.coalesce("here", "there").alias("uuid"), F.when(F.col("here").isNotNull(), 7).otherwise(8).alias("step"))
    return found.unionByName(last).drop("scope", "of")
