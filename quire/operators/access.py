"""Data quality, roles and who may do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ladder of roles, lowest first.
LADDER = ("viewer", "member", "admin", "owner")


def rank(role) -> Column:
    return F.array_position(F.array(*map(F.lit, LADDER)), F.col(role) if isinstance(role, str) else role)


def check_constraints(name: str, df: DataFrame, key: list[str], enums: dict[str, list[str]] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None, at_most_one: list[tuple[list[str], Column]] | None = None) -> DataFrame:
    """Violations: (table, rule, key, n) for keys that repeat, values outside an enumeration, references without a row, and
    groups with more than one row of a kind."""
    text = lambda cols: F.concat_ws("/", *(F.col(c).cast("string") for c in cols))
    row = lambda d, rule, cols: d.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), text(cols).alias("key"), F.col("n").cast("long").alias("n"))
    found = [row(df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "unique " + ",".join(key), key)]
    for c, allowed in (enums or {}).items():
        found.append(row(df.filter(~F.col(c).isin(allowed)).groupBy(c).agg(F.count("*").alias("n")), f"enum {c}", [c]))
    for c, (other, k) in (parents or {}).items():
        found.append(row(df.filter(F.col(c).isNotNull()).join(other.select(F.col(k).alias(c)), c, "left_anti").groupBy(c).agg(F.count("*").alias("n")), f"orphan {c}", [c]))
    for by, kind in at_most_one or []:
        found.append(row(df.filter(kind).groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"), "at most one per " + ",".join(by), by))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check_spine_updates(before: DataFrame, after: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, column) of fixed columns that changed in canonical rows."""
    a = after.select(key, *(F.col(c).alias(f"_{c}") for c in fixed))
    both = before.filter("canonical").join(a, key)
    bad = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fixed)))
    return both.select(key, F.explode(bad).alias("column"))


def effective_role(asks: DataFrame, mem: DataFrame, central_org: int) -> DataFrame:
    """Adds role for (user_id, org_id): the own one, else admin for members of the central team, else none."""
    own = mem.select("user_id", "org_id", F.col("role").alias("_own"))
    central = mem.filter(F.col("org_id") == central_org).select("user_id", F.lit("admin").alias("_c")).distinct()
    return asks.join(own, ["user_id", "org_id"], "left").join(central, "user_id", "left").withColumn("role", F.coalesce("_own", "_c", F.lit("none"))).drop("_own", "_c")


def visible_documents(doc: DataFrame, mem: DataFrame, central_org: int) -> DataFrame:
    """(user_id, document_id, role): documents of one's own teams, and all of them for the central team.

    A document is claimed by its own team and by the central one, and members meet it by the team, so that the central
    team is one key of an equal join (a large one, which adaptive execution splits) and nothing is joined without a key."""
    own = mem.join(doc, "org_id").select("user_id", "document_id", "role")
    claims = doc.select("document_id", F.col("org_id").alias("home"), F.explode(F.array_distinct(F.array("org_id", F.lit(central_org).cast(doc.schema["org_id"].dataType)))).alias("org_id"))
    stewards = mem.filter(F.col("org_id") == central_org).select("user_id", "org_id").distinct()
    every = claims.filter(~F.col("home").eqNullSafe(F.col("org_id"))).join(stewards, "org_id")
    every = every.join(mem.select("user_id", F.col("org_id").alias("home")), ["user_id", "home"], "left_anti")
    return own.unionByName(every.select("user_id", "document_id", F.lit("admin").alias("role")))


def may_change(requests: DataFrame, mem: DataFrame) -> DataFrame:
    """Adds allowed and reason to requests (org_id, actor_role, user_id, self, to); to is a role or null for removal.

    Owners may set any role; admins may move people below them to roles below theirs; anybody may leave. A team keeps its
    last owner."""
    owners = F.count_if(F.col("role") == "owner").over(Window.partitionBy("org_id"))
    m = mem.withColumn("_owners", owners).select("org_id", "user_id", F.col("role").alias("from"), "_owners")
    x = requests.join(m, ["org_id", "user_id"], "left")
    last = (F.col("from") == "owner") & (F.col("_owners") == 1) & ~F.coalesce(F.col("to") == "owner", F.lit(False))
    up = rank(F.coalesce("to", F.lit("viewer")))
    why = (
        F.when(F.col("from").isNull(), "not on the team").when(last, "the last owner stays").when(F.col("self") & F.col("to").isNull(), None).when(F.col("actor_role") == "owner", None)
        .when((F.col("actor_role") == "admin") & (rank("from") < rank("actor_role")) & (up < rank("actor_role")), None).otherwise("the role does not reach")
    )
    return x.withColumn("reason", why).withColumn("allowed", F.col("reason").isNull()).drop("_owners", "from")


def grantable(actors: DataFrame) -> DataFrame:
    """(org_id, user_id, to): the roles that each actor (org_id, user_id, actor_role) may bring somebody in at. Owners give
    any role, admins those below their own, others none."""
    x = actors.withColumn("to", F.explode(F.array(*(F.lit(r) for r in ("viewer", "member", "admin", "owner")))))
    reach = (F.col("actor_role") == "owner") | ((F.col("actor_role") == "admin") & (rank("to") < rank("actor_role")))
    return x.filter(reach).select("org_id", "user_id", "to")


def live_links(links: DataFrame, mem: DataFrame, now: Column) -> DataFrame:
    """Invitations neither revoked nor past, whose maker may still invite."""
    makers = mem.filter(rank("role") >= rank(F.lit("admin"))).select(F.col("user_id").alias("made_by"), "org_id")
    return links.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).join(makers, ["made_by", "org_id"], "left_semi")


def leadless_teams(mem: DataFrame) -> DataFrame:
    return mem.groupBy("org_id").agg(F.count_if(F.col("role") == "owner").alias("owners"), F.count("*").alias("members")).filter("owners = 0").select("org_id", "members")


def notification_recipients(doc: DataFrame, mem: DataFrame, floor: str, deals: int = 64) -> DataFrame:
    """(document_id, user_id): every document with everybody in its team whose role reaches the floor.

    A row for each such pair is asked for. A team's documents are dealt into `deals` parts, each of which meets a copy of its
    members, so a large team is no single task's work; members are hashed, not sorted, and held once for each part."""
    at = doc.withColumn("_deal", F.pmod(F.xxhash64("document_id"), F.lit(deals)))
    able = mem.filter(rank("role") >= rank(F.lit(floor))).select("org_id", "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("_deal"))
    return at.join(able.hint("shuffle_hash"), ["org_id", "_deal"]).select("document_id", "user_id")


def mentioned_recipients(mentions: DataFrame, doc: DataFrame, mem: DataFrame, central_org: int) -> DataFrame:
    """(document_id, user_id) of mentioned people, once each, who may read the document: members of its team or the central one."""
    said = mentions.select("document_id", "user_id").distinct().join(doc.select("document_id", "org_id"), "document_id")
    return effective_role(said, mem, central_org).filter("role <> 'none'").select("document_id", "user_id")


def roster_order(mem: DataFrame) -> DataFrame:
    """Adds place: role from the top of the ladder, then name."""
    return mem.withColumn("place", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc(rank("role")), "name", "user_id")).cast("long"))


def team_roster(mem: DataFrame, doc: DataFrame) -> DataFrame:
    """(org_id, home, members): the team's home document (a pathway first, then the smallest id) and its size."""
    home = doc.withColumn("_n", F.row_number().over(Window.partitionBy("org_id").orderBy(F.when(F.col("kind") == "pathway", 0).otherwise(1), "document_id"))).filter("_n = 1")
    return mem.groupBy("org_id").agg(F.count("*").alias("members")).join(home.select("org_id", F.col("document_id").alias("home")), "org_id", "left")


def team_view(asks: DataFrame, mem: DataFrame, doc: DataFrame, central_org: int) -> DataFrame:
    """(viewer, org_id, standing, home, place, user_id, role): what a viewer is shown of a team, member by member in roster
    order. asks: (viewer, org_id). A viewer's standing is the own role, or steward for members of the central team; others
    are shown nothing."""
    own = mem.select("org_id", F.col("user_id").alias("viewer"), F.col("role").alias("_own"))
    central = mem.filter(F.col("org_id") == central_org).select(F.col("user_id").alias("viewer"), F.lit("steward").alias("_c")).distinct()
    seen = asks.join(own, ["org_id", "viewer"], "left").join(central, "viewer", "left").withColumn("standing", F.coalesce("_own", "_c")).filter("standing is not null")
    home = team_roster(mem, doc).select("org_id", "home")
    return seen.join(home, "org_id").join(roster_order(mem).select("org_id", "user_id", "role", "place"), "org_id").select("viewer", "org_id", "standing", "home", "place", "user_id", "role")


def mentionable_people(mem: DataFrame, central_org: int, org_id: int) -> DataFrame:
    """One's own team, then the central one, each person once."""
    rows = mem.filter(F.col("org_id").isin(org_id, central_org)).withColumn("_p", (F.col("org_id") != org_id).cast("int"))
    w = Window.partitionBy("user_id").orderBy("_p")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("user_id", "name", F.col("_p").cast("long").alias("group"))


def semi_in(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    return df.join(values.select(key), key, "left_semi")


def library_entries(published: DataFrame, guides: DataFrame) -> DataFrame:
    """Published documents with whether they have a guide."""
    g = guides.select("document_id").distinct().withColumn("has_guide", F.lit(True))
    return published.join(g, "document_id", "left").na.fill(False, ["has_guide"])


def jump_index(visible: DataFrame, published: DataFrame) -> DataFrame:
    """(document_id, published): documents that a caller can open and every published one."""
    p = published.select("document_id", F.lit(True).alias("published"))
    return visible.select("document_id").distinct().join(p, "document_id", "full_outer").na.fill(False, ["published"])


def link_targets(outlined_live: DataFrame, published: DataFrame) -> DataFrame:
    """(kind, id, title): live sections and published documents as one catalogue."""
    return outlined_live.select(F.lit("section").alias("kind"), "id", "title").unionByName(published.select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), "title"))
