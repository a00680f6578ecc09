"""Queries of versions, reviews and the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as O
from ..sources import bindings as B
from ..sources.settled import settle
from .registry import register

_DRAFT = """draft AS (SELECT s.*, v.document_id FROM version_sections s JOIN versions v USING (version_id) WHERE v.status = 'draft'),
pub AS (SELECT s.*, v.document_id FROM version_sections s JOIN versions v USING (version_id) WHERE v.status = 'published')"""
_PINS = """dpins AS (SELECT document_id, section_id, body_hash, 'changed' AS change, CASE (document_id * 7 + section_id) % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'changes_requested' END AS decision FROM draft WHERE (document_id + section_id) % 3 = 0)"""
_V = B.with_clauses(B.VERSIONS, B.VERSION_SECTIONS, _DRAFT)
_VP = B.with_clauses(B.VERSIONS, B.VERSION_SECTIONS, _DRAFT, _PINS)
_DOCS = """docs AS (SELECT c_custkey AS document_id, lower(c_name) AS slug, CASE WHEN c_custkey % 5 = 0 THEN 'partner-' || c_custkey END AS partner_slug, c_name AS title, c_mktsegment AS subject,
  CASE WHEN c_nationkey % 6 = 0 THEN 'pending:' || c_nationkey ELSE 'org-' || c_nationkey END AS org FROM customer)"""


def documents(spark, d):
    c = B.read(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("document_id"), F.lower("c_name").alias("slug"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("partner-"), "c_custkey")).alias("partner_slug"),
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subject"), F.concat(F.when(F.col("c_nationkey") % 6 == 0, "pending:").otherwise("org-"), "c_nationkey").alias("org"),
    )


def sides(spark, d):
    return O.draft_and_published(B.versions(spark, d), B.version_sections(spark, d))


def pins(draft):
    x = (F.col("document_id") * 7 + F.col("section_id")) % 5
    return draft.filter((F.col("document_id") + F.col("section_id")) % 3 == 0).select("document_id", "section_id", "body_hash", F.lit("changed").alias("change"), F.when(x == 0, "approved").when(x == 1, "changes_requested").alias("decision"))


@register("published_versions", B.with_clauses(B.VERSIONS, _DOCS) + "SELECT document_id, slug, version_id, version_no FROM docs JOIN versions USING (document_id) WHERE status = 'published'")
def _(spark, d):
    return O.published_versions(documents(spark, d), B.versions(spark, d)).select("document_id", "slug", "version_id", "version_no")


@register("published_sections", _V + "SELECT document_id, section_id, body_hash FROM pub WHERE NOT hidden")
def _(spark, d):
    return O.published_sections(B.versions(spark, d), B.version_sections(spark, d)).select("document_id", "section_id", "body_hash")


_Q = "q AS (SELECT document_id AS query_id, CASE WHEN document_id % 10 = 0 THEN partner_slug WHEN document_id % 7 = 0 THEN 'none' ELSE slug END AS slug, CASE WHEN document_id % 3 = 0 THEN document_id % 4 END AS no FROM docs)"


@register("resolve_slug", B.with_clauses(B.VERSIONS, _DOCS, _Q) + """, hit AS (SELECT q.query_id, v.document_id, v.version_id FROM q JOIN docs t ON q.slug = coalesce(t.partner_slug, '') OR q.slug = t.slug
  JOIN versions v ON v.document_id = t.document_id WHERE v.status IN ('published', 'archived') AND CASE WHEN q.no IS NULL THEN v.status = 'published' ELSE v.version_no = q.no END)
  SELECT q.query_id, document_id, version_id, version_id IS NOT NULL AS found FROM q LEFT JOIN hit USING (query_id)""")
def _(spark, d):
    doc = documents(spark, d)
    slug = F.when(F.col("document_id") % 10 == 0, F.col("partner_slug")).when(F.col("document_id") % 7 == 0, "none").otherwise(F.col("slug"))
    q = doc.select(F.col("document_id").alias("query_id"), slug.alias("slug"), F.when(F.col("document_id") % 3 == 0, F.col("document_id") % 4).alias("version_no"))
    return O.resolve_slug(q, doc, B.versions(spark, d))


_STATE = """state AS (SELECT r.review_id, r.version_id, r.requested_at, count(p.section_id) AS total, count(p.decision) AS decided, count(*) FILTER (p.decision = 'approved') AS approved, count(*) FILTER (p.decision = 'changes_requested') AS changes_requested
  FROM reviews r LEFT JOIN pins p USING (review_id) GROUP BY 1, 2, 3)"""
_DECIDED = "CASE WHEN changes_requested > 0 THEN 'changes_requested' WHEN total > 0 AND decided = total THEN 'approved' END AS decision"


@register("review_state", B.with_clauses(B.REVIEWS, _STATE) + f"SELECT review_id, total, decided, approved, changes_requested, {_DECIDED} FROM state")
def _(spark, d):
    return O.review_state(*B.reviews(spark, d)).drop("version_id", "requested_at")


@register("current_review", B.with_clauses(B.REVIEWS, _STATE) + f"SELECT review_id, version_id, decision FROM (SELECT *, {_DECIDED}, row_number() OVER (PARTITION BY version_id ORDER BY requested_at DESC, review_id DESC) AS n FROM state) WHERE n = 1")
def _(spark, d):
    return O.current_review(O.review_state(*B.reviews(spark, d))).select("review_id", "version_id", "decision")


@register("superseded_reviews", B.with_clauses(B.REVIEWS) + "SELECT review_id, EXISTS (SELECT 1 FROM reviews o WHERE o.version_id = r.version_id AND o.requested_at > r.requested_at) AS superseded FROM reviews r")
def _(spark, d):
    return O.superseded_reviews(B.reviews(spark, d)[0]).select("review_id", "superseded")


_TICKS = """ticks AS (SELECT d.document_id, d.section_id, d.order_index, CASE WHEN i.section_id IS NOT NULL THEN coalesce(i.decision, 'in_review') WHEN p.section_id IS NULL THEN 'new' WHEN p.body_hash = d.body_hash THEN 'published' ELSE 'changed' END AS state
  FROM draft d LEFT JOIN pub p USING (document_id, section_id) LEFT JOIN dpins i USING (document_id, section_id))"""
_BANDS = "bands AS (SELECT section_id, CASE WHEN section_id <= 2 THEN 'front' WHEN section_id <= 5 THEN 'step' ELSE 'back' END AS band FROM range(1, 20) t(section_id))"


def ticks(spark, d):
    draft, pub = sides(spark, d)
    return O.tick_states(draft, pub, pins(draft))


def bands(spark):
    return spark.range(1, 20).select(F.col("id").alias("section_id"), F.when(F.col("id") <= 2, "front").when(F.col("id") <= 5, "step").otherwise("back").alias("band"))


@register("tick_states", _VP + "," + _TICKS + " SELECT document_id, section_id, state FROM ticks")
def _(spark, d):
    return ticks(spark, d).select("document_id", "section_id", "state")


@register("tick_summary", _VP + "," + _TICKS + """ SELECT document_id, count(*) FILTER (state = 'published') AS published, count(*) FILTER (state IN ('changed', 'new')) AS changed, count(*) FILTER (state = 'in_review') AS in_review,
  count(*) FILTER (state = 'approved') AS approved, count(*) FILTER (state = 'changes_requested') AS changes_requested FROM ticks GROUP BY 1""")
def _(spark, d):
    return O.tick_summary(ticks(spark, d))


@register("tick_runs", _VP + "," + _TICKS + """, f AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY document_id ORDER BY order_index, section_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY order_index, section_id) AS run FROM f)
  SELECT document_id, CAST(run AS BIGINT) AS run, min(state) AS state, count(*) AS length FROM r GROUP BY 1, 2""")
def _(spark, d):
    return O.tick_runs(ticks(spark, d))


_ATLAS = "atlas AS (SELECT document_id, band, string_agg(state, ',' ORDER BY order_index, section_id) AS ticks, count(*) FILTER (state IN ('changed', 'new')) AS changed FROM ticks JOIN bands USING (section_id) GROUP BY 1, 2)"


@register("atlas", _VP + "," + _TICKS + "," + _BANDS + "," + _ATLAS + " SELECT * FROM atlas")
def _(spark, d):
    return O.atlas(ticks(spark, d), bands(spark))


@register("band_density", _VP + "," + _TICKS + "," + _BANDS + "," + _ATLAS + " SELECT band, CAST(max(len(string_split(ticks, ','))) AS BIGINT) AS most FROM atlas GROUP BY 1")
def _(spark, d):
    return O.band_density(O.atlas(ticks(spark, d), bands(spark)))


@register("band_detail", _VP + "," + _TICKS + "," + _BANDS + " SELECT document_id, section_id, state FROM ticks JOIN bands USING (section_id) WHERE band = 'front' AND document_id = (SELECT min(document_id) FROM ticks)")
def _(spark, d):
    t = ticks(spark, d)
    first = t.agg(F.min("document_id").alias("document_id"))
    return O.band_detail(t.join(F.broadcast(first), "document_id"), bands(spark), F.col("document_id"), "front").select("document_id", "section_id", "state")


@register("last_change", "SELECT document_id, x.a AS changed_at, x.b AS changed_by FROM (SELECT user_id AS document_id, max({'a': ts, 'b': event_id}) AS x FROM events GROUP BY 1)")
def _(spark, d):
    return O.last_change(B.activity(spark, d), "document_id", "at", "event_id")


_CHANGED = """rows AS (SELECT s.*, v.document_id, v.version_no FROM version_sections s JOIN versions v USING (version_id)),
marked AS (SELECT *, CASE WHEN lag(body_hash) OVER w = body_hash AND lag(hidden) OVER w = hidden THEN NULL ELSE version_no END AS since FROM rows WINDOW w AS (PARTITION BY document_id, section_id ORDER BY version_no)),
changed AS (SELECT *, last_value(since IGNORE NULLS) OVER (PARTITION BY document_id, section_id ORDER BY version_no ROWS UNBOUNDED PRECEDING) AS last_changed_version_no FROM marked)"""


@register("last_changed_version", B.with_clauses(B.VERSIONS, B.VERSION_SECTIONS, _CHANGED) + "SELECT version_id, section_id, last_changed_version_no FROM changed")
def _(spark, d):
    return O.last_changed_version(B.version_sections(spark, d), B.versions(spark, d)).select("version_id", "section_id", "last_changed_version_no")


@register("editions_imprint", B.with_clauses(B.VERSIONS, B.VERSION_SECTIONS, _CHANGED) + "SELECT document_id, version_no, count(*) AS sections, count(*) FILTER (last_changed_version_no = version_no) AS changed FROM changed WHERE NOT hidden GROUP BY 1, 2")
def _(spark, d):
    return O.editions_imprint(O.last_changed_version(B.version_sections(spark, d), B.versions(spark, d)))


@register("next_version_no", B.with_clauses(B.VERSIONS) + "SELECT document_id, max(version_no) + 1 AS next_no, count(*) FILTER (status = 'draft') AS drafts FROM versions GROUP BY 1")
def _(spark, d):
    return O.next_version_no(B.versions(spark, d))


@register("version_history", B.with_clauses(B.VERSIONS) + "SELECT document_id, version_id, version_no, status, label, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS place FROM versions")
def _(spark, d):
    return O.version_history(B.versions(spark, d)).drop("published_at")


@register("recent_activity", B.with_clauses(B.ACTIVITY) + "SELECT document_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY \"at\" DESC, event_id DESC) AS place FROM activity) WHERE place <= 30")
def _(spark, d):
    return O.recent_activity(B.activity(spark, d)).select("document_id", "event_id", "place")


@register("newest_published", B.with_clauses(B.VERSIONS) + "SELECT document_id, version_id FROM versions WHERE status = 'published' ORDER BY published_at DESC, document_id LIMIT 5")
def _(spark, d):
    return O.newest_published(B.versions(spark, d).filter("status = 'published'"), 5).select("document_id", "version_id")


_REG = """reg AS (SELECT d.document_id, d.slug, d.title, d.org, d.subject, p.version_no AS published_no, coalesce(t.changed, 0) AS changed, coalesce(t.total, 0) AS total, coalesce(t.decided, 0) AS decided, coalesce(t.pinned, 0) > 0 AND d.document_id % 2 = 0 AS in_review
  FROM docs d LEFT JOIN (SELECT document_id, version_no FROM versions WHERE status = 'published') p USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) FILTER (state IN ('changed', 'new')) AS changed, count(*) AS total, count(*) FILTER (state IN ('approved', 'changes_requested')) AS decided, count(*) FILTER (state = 'in_review') AS pinned FROM ticks GROUP BY 1) t USING (document_id))"""
_WREG = _VP + "," + _TICKS + "," + _DOCS + "," + _REG


def reg(spark, d):
    t = ticks(spark, d).groupBy("document_id").agg(
        F.count_if(F.col("state").isin("changed", "new")).alias("changed"), F.count("*").alias("total"), F.count_if(F.col("state").isin("approved", "changes_requested")).alias("decided"), F.count_if(F.col("state") == "in_review").alias("pinned")
    )
    p = B.versions(spark, d).filter("status = 'published'").select("document_id", F.col("version_no").alias("published_no"))
    out = documents(spark, d).join(p, "document_id", "left").join(t, "document_id", "left").na.fill(0, ["changed", "total", "decided", "pinned"])
    return out.withColumn("in_review", (F.col("pinned") > 0) & (F.col("document_id") % 2 == 0))


@register("standing", _WREG + """SELECT document_id, CASE WHEN published_no IS NULL THEN 'Not published' WHEN in_review AND decided < total THEN 'In review: ' || decided || ' of ' || total
  WHEN changed > 0 THEN changed || CASE WHEN changed = 1 THEN ' change' ELSE ' changes' END || ' since edition ' || published_no ELSE 'Edition ' || published_no END AS standing FROM reg""")
def _(spark, d):
    return O.standing(reg(spark, d)).select("document_id", "standing")


@register("register_filter", _WREG + "SELECT document_id FROM reg WHERE changed > 0 AND contains(lower(title || chr(10) || slug || chr(10) || org || chr(10) || subject), 'org-1')")
def _(spark, d):
    return O.register_filter(reg(spark, d), "changed", "ORG-1").select("document_id")


@register("pending_documents", B.with_clauses(_DOCS) + "SELECT document_id, org FROM docs WHERE starts_with(org, 'pending:')")
def _(spark, d):
    return O.pending_documents(documents(spark, d)).select("document_id", "org")


@register("order_register", _WREG + "SELECT document_id, org, row_number() OVER (PARTITION BY org ORDER BY changed DESC, title, document_id) AS place FROM reg")
def _(spark, d):
    return O.order_register(reg(spark, d), "changed").select("document_id", "org", "place")


@register("register_totals", _WREG + "SELECT count(*) AS documents, count(*) FILTER (in_review) AS in_review, count(*) FILTER (changed > 0) AS changed, count(*) FILTER (published_no IS NULL) AS unpublished FROM reg")
def _(spark, d):
    return O.register_totals(reg(spark, d))


@register("document_list_state", B.with_clauses(B.VERSIONS, _DOCS, B.VERSION_SECTIONS, _DRAFT, _PINS) + """, rv AS (SELECT version_id, document_id, count(i.section_id) AS total, count(i.decision) AS decided, count(*) FILTER (i.decision = 'changes_requested') AS bad
  FROM draft d JOIN dpins i USING (document_id, section_id) GROUP BY 1, 2)
  SELECT d.document_id, p.version_no AS published_no, coalesce(r.total > 0 AND r.bad = 0 AND r.decided < r.total, false) AS in_review FROM docs d LEFT JOIN (SELECT * FROM versions WHERE status = 'published') p USING (document_id) LEFT JOIN rv r ON r.document_id = d.document_id""")
def _(spark, d):
    draft, _pub = sides(spark, d)
    i = pins(draft).withColumn("review_id", F.col("document_id"))
    rev = i.select("review_id").distinct().join(B.versions(spark, d).filter("status = 'draft'").select(F.col("document_id").alias("review_id"), "version_id"), "review_id").withColumn("requested_at", F.col("review_id"))
    return O.document_list_state(documents(spark, d), B.versions(spark, d), O.review_state(rev, i))


#: Section n of an order stands beneath section n div 2.
_CHANGES = """placed AS (
  SELECT d.*, coalesce(a.hidden, false) AS under, coalesce(a.hidden, false) OR coalesce(b.hidden, false) OR coalesce(c.hidden, false) AS beneath
  FROM draft d LEFT JOIN draft a ON a.document_id = d.document_id AND a.section_id = d.section_id // 2
  LEFT JOIN draft b ON b.document_id = d.document_id AND b.section_id = a.section_id // 2 LEFT JOIN draft c ON c.document_id = d.document_id AND c.section_id = b.section_id // 2),
changes AS (
  SELECT d.document_id, d.section_id, d.order_index, CASE WHEN d.hidden THEN 'removed' WHEN p.section_id IS NULL THEN 'new' ELSE 'changed' END AS change, d.body_hash
  FROM placed d LEFT JOIN pub p USING (document_id, section_id)
  WHERE (NOT d.hidden AND NOT d.beneath AND (p.section_id IS NULL OR p.body_hash <> d.body_hash)) OR (d.hidden AND NOT d.under AND NOT coalesce(p.hidden, false)))"""


def changes(spark, d, both=None):
    draft, published = both or sides(spark, d)
    return O.reviewable_changes(draft.withColumn("parent_id", F.nullif(F.expr("section_id div 2"), F.lit(0))), published)


@register("reviewable_changes", _V + "," + _CHANGES + " SELECT document_id, section_id, change, body_hash FROM changes")
def _(spark, d):
    return changes(spark, d).drop("order_index")


@register("changes_union", _V + "," + _CHANGES + " SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY order_index, section_id) AS place FROM changes")
def _(spark, d):
    return O.changes_union(changes(spark, d)).select("document_id", "section_id", "place")


@register("structure_changes", _V + "SELECT d.document_id, d.section_id, CASE WHEN p.section_id IS NULL THEN 'added' ELSE 'hidden' END AS what FROM draft d LEFT JOIN pub p USING (document_id, section_id) WHERE p.section_id IS NULL OR d.hidden AND NOT p.hidden")
def _(spark, d):
    return O.structure_changes(*sides(spark, d))


@register("request_review", _V + "," + _CHANGES + " SELECT substr(sha256('review/' || document_id), 1, 16) AS review_id, document_id, section_id, change, body_hash FROM changes")
def _(spark, d):
    return O.request_review(changes(spark, d))


@register("unreviewed_changes", _VP + "," + _CHANGES + " SELECT document_id, section_id, change FROM changes c WHERE NOT EXISTS (SELECT 1 FROM dpins i WHERE i.document_id = c.document_id AND i.section_id = c.section_id AND i.change = c.change)")
def _(spark, d):
    draft, _p = sides(spark, d)
    return O.unreviewed_changes(changes(spark, d), pins(draft)).select("document_id", "section_id", "change")


_OLD = "old AS (SELECT document_id, section_id, CASE WHEN section_id % 2 = 0 THEN 'gone' ELSE body_hash END AS body_hash FROM dpins)"


@register("review_drift", _VP + "," + _CHANGES + "," + _OLD + " SELECT o.document_id, o.section_id, CASE WHEN c.body_hash IS NULL THEN 'undone' ELSE 'stale' END AS drift FROM old o LEFT JOIN changes c USING (document_id, section_id) WHERE c.body_hash IS NULL OR c.body_hash <> o.body_hash")
def _(spark, d):
    draft, _p = sides(spark, d)
    old = pins(draft).withColumn("body_hash", F.when(F.col("section_id") % 2 == 0, "gone").otherwise(F.col("body_hash")))
    return O.review_drift(old, changes(spark, d))


@register("review_progress", _VP + "," + _CHANGES + " SELECT c.document_id, CASE WHEN c.section_id <= 3 THEN 'front' ELSE 'body' END AS part, count(i.section_id) AS covered, count(i.decision) AS decided, count(*) AS changes FROM changes c LEFT JOIN dpins i USING (document_id, section_id) GROUP BY 1, 2")
def _(spark, d):
    draft, _p = sides(spark, d)
    return O.review_progress(changes(spark, d), pins(draft), F.when(F.col("section_id") <= 3, "front").otherwise("body"))


@register("needs_attention", _VP + "," + _CHANGES + """, c AS (SELECT c.*, i.decision FROM changes c LEFT JOIN dpins i USING (document_id, section_id)), r AS (SELECT document_id, CASE WHEN count(*) FILTER (decision = 'changes_requested') > 0 THEN 'changes_requested' WHEN count(decision) = count(*) THEN 'approved' END AS d FROM dpins GROUP BY 1)
  SELECT c.document_id, c.section_id FROM c LEFT JOIN r USING (document_id) WHERE r.document_id IS NULL OR (r.d IS NULL AND c.decision IS NULL) OR (r.d IS NOT NULL AND c.decision = 'changes_requested')""")
def _(spark, d):
    draft, published = sides(spark, d)
    draft = settle(draft)  # read for the changes and, three times, for the pins
    i = pins(draft).withColumn("review_id", F.col("document_id"))
    state = O.review_state(i.select("review_id").distinct(), i).withColumnRenamed("review_id", "document_id")
    c = changes(spark, d, (draft, published)).join(pins(draft).select("document_id", "section_id", "decision"), ["document_id", "section_id"], "left")
    return O.needs_attention(c, state)


@register("compare_editions", _V + """SELECT document_id, section_id, change FROM (SELECT coalesce(p.document_id, d.document_id) AS document_id, coalesce(p.section_id, d.section_id) AS section_id,
  CASE WHEN p.section_id IS NULL THEN CASE WHEN NOT d.hidden THEN 'added' END WHEN d.section_id IS NULL THEN CASE WHEN NOT p.hidden THEN 'removed' END WHEN p.hidden AND d.hidden THEN NULL WHEN d.hidden THEN 'hidden' WHEN p.hidden THEN 'shown' WHEN p.body_hash <> d.body_hash THEN 'changed' END AS change
  FROM pub p FULL JOIN draft d ON p.document_id = d.document_id AND p.section_id = d.section_id) WHERE change IS NOT NULL""")
def _(spark, d):
    draft, pub = sides(spark, d)
    return O.compare_editions(pub, draft)


@register("edition_changes", _V + """, c AS (
    SELECT coalesce(p.document_id, d.document_id) AS document_id, coalesce(p.section_id, d.section_id) AS section_id, CASE
      WHEN p.section_id IS NULL THEN CASE WHEN NOT d.hidden THEN 'added' END WHEN d.section_id IS NULL THEN CASE WHEN NOT p.hidden THEN 'removed' END
      WHEN p.hidden AND d.hidden THEN NULL WHEN d.hidden THEN 'hidden' WHEN p.hidden THEN 'shown' WHEN p.body_hash <> d.body_hash THEN 'changed' END AS change
    FROM pub p FULL JOIN draft d ON p.document_id = d.document_id AND p.section_id = d.section_id),
  o AS (SELECT document_id, section_id, CASE WHEN section_id % 3 = 0 THEN 'front' ELSE 'body' END AS band, -section_id AS position FROM draft),
  j AS (SELECT c.*, band, position, min(position) OVER (PARTITION BY c.document_id, band) AS first FROM c LEFT JOIN o USING (document_id, section_id) WHERE change IS NOT NULL)
  SELECT document_id, section_id, change, coalesce(band, 'outside') AS band,
    row_number() OVER (PARTITION BY document_id ORDER BY first NULLS LAST, position NULLS LAST, section_id) AS place FROM j""")
def _(spark, d):
    """The outline is the draft's, read from its end, with every third section in the front."""
    draft, pub = sides(spark, d)
    n = F.col("section_id")
    return O.edition_changes(pub, draft, draft.select("document_id", "section_id", F.when(n % 3 == 0, "front").otherwise("body").alias("band"), (-n).alias("position")))


@register("compose", _V + """, a AS (SELECT document_id AS pair, section_id AS address, order_index FROM pub), b AS (SELECT document_id AS pair, section_id AS address, order_index, hidden FROM draft),
  r AS (SELECT pair, address, order_index AS at, 'a' AS source, NULL AS own FROM a UNION ALL SELECT b.pair, b.address, a.order_index, 'b', b.order_index FROM b LEFT JOIN a USING (pair, address) WHERE b.hidden)
  SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY \"at\" NULLS LAST, source, own, address) AS place, address, source FROM r""")
def _(spark, d):
    draft, pub = sides(spark, d)
    cut = lambda x: x.select(F.col("document_id").alias("pair"), F.col("section_id").alias("address"), "order_index", F.col("hidden").alias("owned"))
    return O.compose(cut(pub), cut(draft))


_SHARED = """core AS (SELECT c_mktsegment AS seg, min(c_custkey) AS k FROM customer GROUP BY 1), sec AS (SELECT d.document_id, d.section_id, CASE WHEN d.document_id <> c.k THEN c.k * 100 + d.section_id END AS core_id, d.section_id % 3 = 0 AND d.document_id % 2 = 0 AS diverged, CASE WHEN d.section_id % 5 <> 4 THEN d.body END AS body, d.section_id = 7 AS apparatus
  FROM draft d JOIN customer t ON t.c_custkey = d.document_id JOIN core c ON c.seg = t.c_mktsegment)"""


def shared(spark, d):
    c = B.read(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), "c_mktsegment")
    core = c.groupBy("c_mktsegment").agg(F.min("document_id").alias("k"))
    draft, pub = sides(spark, d)
    s = draft.join(c, "document_id").join(core, "c_mktsegment")
    sec = s.select("document_id", "section_id", F.when(F.col("document_id") != F.col("k"), F.col("k") * 100 + F.col("section_id")).alias("core_id"), ((F.col("section_id") % 3 == 0) & (F.col("document_id") % 2 == 0)).alias("diverged"), F.when(F.col("section_id") % 5 != 4, F.col("body")).alias("body"), (F.col("section_id") == 7).alias("apparatus"))
    num = lambda x: x.select((F.col("document_id") * 100 + F.col("section_id")).alias("section_id"), "body")
    return sec, num(pub), num(draft)


@register("resolve_shared", _V + "," + _SHARED + """ SELECT s.document_id, s.section_id, CASE WHEN s.core_id IS NULL THEN s.body ELSE coalesce(p.body, q.body) END AS body, CASE WHEN s.core_id IS NULL THEN 'own' WHEN p.body IS NOT NULL THEN 'published' WHEN q.body IS NOT NULL THEN 'draft' END AS core_source
  FROM sec s LEFT JOIN pub p ON p.document_id * 100 + p.section_id = s.core_id LEFT JOIN draft q ON q.document_id * 100 + q.section_id = s.core_id""")
def _(spark, d):
    return O.resolve_shared(*shared(spark, d)).select("document_id", "section_id", "body", "core_source")


@register("section_mark", _V + "," + _SHARED + """ SELECT document_id, section_id, CASE WHEN apparatus THEN 'instructions' WHEN core_id IS NOT NULL AND NOT diverged THEN 'shared' WHEN core_id IS NOT NULL THEN 'diverged' WHEN body IS NULL THEN 'scaffold' ELSE 'owned' END AS mark FROM sec""")
def _(spark, d):
    return O.section_mark(shared(spark, d)[0]).select("document_id", "section_id", "mark")


@register("diverged_from", _V + "," + _SHARED + " SELECT core_id, string_agg(x, ',' ORDER BY x) AS documents, count(*) AS n FROM (SELECT DISTINCT core_id, CAST(document_id AS VARCHAR) AS x FROM sec WHERE core_id IS NOT NULL AND diverged) GROUP BY 1")
def _(spark, d):
    return O.diverged_from(shared(spark, d)[0])


@register("publish_readiness", _VP + "," + _CHANGES + "," + _DOCS + """, f AS (SELECT document_id, 'changes' AS gate, 'warn' AS bad, section_id FROM changes UNION ALL SELECT document_id, 'review', 'block', section_id FROM dpins WHERE decision = 'changes_requested'
  UNION ALL SELECT document_id, 'placeholders', 'block', section_id FROM draft WHERE body = 'q0' AND section_id = 1),
  g AS (SELECT document_id, gate, bad, count(*) AS n, string_agg(DISTINCT CAST(section_id AS VARCHAR), ',' ORDER BY CAST(section_id AS VARCHAR)) AS sections FROM f GROUP BY 1, 2, 3), k AS (SELECT * FROM (VALUES ('changes'), ('review'), ('placeholders')) v(gate))
  SELECT d.document_id, k.gate, CASE WHEN n > 0 THEN bad ELSE 'ok' END AS level, coalesce(n, 0) AS n, coalesce(sections, '') AS sections, max(coalesce(n > 0 AND bad = 'block', false)) OVER (PARTITION BY d.document_id) AS blocked FROM docs d CROSS JOIN k LEFT JOIN g ON g.document_id = d.document_id AND g.gate = k.gate""")
def _(spark, d):
    draft, _p = sides(spark, d)
    gates = [("changes", "warn", changes(spark, d)), ("review", "block", pins(draft).filter("decision = 'changes_requested'")), ("placeholders", "block", draft.filter("body = 'q0' and section_id = 1"))]
    return O.publish_readiness(documents(spark, d), gates)


@register("comment_threads", B.with_clauses(B.COMMENTS) + """SELECT r.id AS root, r.document_id, r.open, count(c.id) AS n_replies, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.created_at, c.id), '') AS replies
  FROM comments r LEFT JOIN comments c ON c.reply_to = r.id WHERE r.reply_to IS NULL OR r.reply_to NOT IN (SELECT id FROM comments) GROUP BY 1, 2, 3""")
def _(spark, d):
    return O.comment_threads(B.comments(spark, d))


@register("suggestions_for_core", B.with_clauses(B.COMMENTS) + """SELECT CAST(document_id % 8 + 100 AS BIGINT) AS core_id, row_number() OVER (PARTITION BY document_id % 8 ORDER BY open DESC, created_at DESC, id DESC) AS place, id, open FROM comments WHERE kind = 'suggestion' AND reply_to IS NULL AND document_id % 3 <> 0""")
def _(spark, d):
    sec = spark.range(50).select(F.col("id").alias("section_id"), F.when(F.col("id") % 3 != 0, F.col("id") % 8 + 100).alias("core_id"))
    return O.suggestions_for_core(B.comments(spark, d).withColumn("section_id", F.col("document_id")), sec)


@register("diversify", """WITH h AS (SELECT o_orderpriority AS query_id, o_custkey AS doc, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) AS n FROM h)
  SELECT query_id, o_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY n > 3, rank) AS place FROM w""")
def _(spark, d):
    from pyspark.sql import Window

    o = B.read(spark, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    hits = o.select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("doc"), "o_orderkey", "rank")
    return O.diversify(hits, "doc", 3).select("query_id", "o_orderkey", "place")
