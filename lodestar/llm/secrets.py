"""Secret scan with corpus-wide ownership frequency, with built-in functions only.

Patterns find candidate spans in every text. The values of all candidates are hashed and aggregated over the whole
corpus by distinct repositories and owners: a value that many owners have is a widely copied example, one that
stays with a few owners and looks random is taken for a live credential. Spans of kind `live` are added for the
latter. Aggregation goes in three steps (value, owner, repository), so that a value that half of the corpus has
is combined before every shuffle; the few values that hold more than one in HOT_SHARE places each are then joined
to their places by broadcast, which their number bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, source_columns
from lodestar.session import cut

#: (kind, pattern, group that holds the value or 0, least characters of it): fixed values of the base kinds.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: A private key from header to end line; one that is cut off has its header and the lines of base64 after it.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++){0,64}+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+){0,400}+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,15}+={1,2}+)?+)"
)
#: Kinds that this scan adds: private keys and signed web tokens.
MORE_KINDS = [
    ("pem", PEM, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
]
#: What must occur for a kind's pattern to be tried at all, where that is cheaper to test.
HINTS = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}", "pem": "PRIVATE KEY", "jwt": r"eyJ[A-Za-z0-9_-]+\."}
#: A value of so many owners is a copied example, as is one of two owners in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
#: A value with more than one in so many of all places, and more than so many, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 1000, 10_000
#: Spans that one step of the position count appends to; more are gathered chunk by chunk.
CHUNK = 256
#: A live-looking value has so many characters and different characters at least, letters and digits.
LIVE_CHARS, LIVE_DISTINCT = 16, 8
#: The same for what is assigned to a password, token or the like, where the name says that it is a secret.
ASSIGNED_CHARS, ASSIGNED_DISTINCT = 6, 5
PLACEHOLDER = r"(?i)example|placeholder|change_?me|dummy|xxxx|your[_-]?(key|token|secret|password)"
MARK = "[SECRET]"

_SPAN = "array<struct<start: bigint, rank: int, kind: string, end: bigint, value: string>>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a kind: array of (start, rank, kind, end, value), in code points.

    The pieces between the matches give the positions: match k starts after k + 1 pieces and k matches. Matches are
    gathered in chunks, so that the work is linear in their number for any text.
    """
    p = F.lit(pattern)
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        grown = F.when(F.length(m["value"]) >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), grown.alias("found"))

    def chunk(state: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(zipped, k * CHUNK + 1, F.lit(CHUNK)), F.struct(state["at"].alias("at"), empty(_SPAN).alias("found")), step)
        after = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found")))
        return F.element_at(after, 1)

    start = F.struct(F.lit(0).cast("long").alias("at"), empty(f"array<{_SPAN}>").alias("found"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int"))
    spans = F.when(F.size(zipped) > 0, F.flatten(F.aggregate(chunks, start, chunk)["found"])).otherwise(empty(_SPAN))
    return F.when(text.rlike(HINTS.get(kind, pattern)), spans).otherwise(empty(_SPAN))


def maybe_secret(text: Column) -> Column:
    """Whether any kind can have a span; a cheap test that never misses one."""
    hit = F.lit(False)
    for kind, pattern, *_ in [*KINDS, *MORE_KINDS]:
        hit = hit | text.rlike(HINTS.get(kind, pattern))
    return F.coalesce(hit, F.lit(False))


def looks_random(value: Column, chars: int = LIVE_CHARS, least: int = LIVE_DISTINCT) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= chars) & (distinct >= least) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def looks_live(kind: Column, value: Column) -> Column:
    """Whether a value of few owners is taken for a credential."""
    more = kind.isin([k for k, *_ in MORE_KINDS])
    return more | looks_random(value) | ((kind == "assign") & looks_random(value, ASSIGNED_CHARS, ASSIGNED_DISTINCT))


def owned(kind: Column, value: Column) -> Column:
    """What owners are counted on: the value, of a private key without its line breaks."""
    return F.when(kind == "pem", F.regexp_replace(value, r"\s|\\[nr]", "")).otherwise(value)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str) -> DataFrame:
    """doc_id, text_key, repo, found: all base and added spans of each whole text. (doc_id, text_key) names a row's content."""
    rows = source_columns(docs, doc_id=id_col, text=text_col, repo=repo_col).withColumn("text", F.coalesce("text", F.lit("")))
    every = [spans_of(F.col("text"), k, *kind) for k, kind in enumerate([*KINDS, *MORE_KINDS])]
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "repo", F.concat(*every).alias("found"))


def live_spans(found: DataFrame) -> DataFrame:
    """doc_id, text_key, live, n_copied of the rows with spans; found is candidates(), already computed."""
    each = found.select("doc_id", "text_key", "repo", F.explode("found").alias("s"))
    each = each.select("doc_id", "text_key", "repo", F.coalesce(F.substring_index("repo", "/", 1), F.lit("")).alias("owner"), "s", F.sha2(owned(F.col("s.kind"), F.col("s.value")), 256).alias("hash"))
    in_repo = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("places"))
    in_owner = in_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("places").alias("places"))
    spread = in_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("places").alias("places"))
    spread = cut(spread)
    total = spread.agg(F.sum("places")).first()[0] or 0
    hot = spread.where(F.col("places") > max(HOT_ROWS, total / HOT_SHARE))  # fewer than HOT_SHARE rows
    few = each.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(spread, "hash")
    met = few.unionByName(each.join(F.broadcast(hot), "hash"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= EXAMPLE_REPOS))
    judged = met.select("doc_id", "text_key", "s", copied.alias("is_copied"), (~copied & looks_live(F.col("s.kind"), F.col("s.value"))).alias("is_live"))
    start = F.when(F.col("s.kind") == "assign", F.col("s.end") - F.length("s.value")).otherwise(F.col("s.start"))
    live = F.struct(start.alias("start"), F.lit(len(KINDS) + len(MORE_KINDS)).alias("rank"), F.lit("live").alias("kind"), F.col("s.end").alias("end"))
    return judged.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("is_live"), live)).alias("live"),
        F.count_distinct(F.when(F.col("is_copied"), F.struct("s.start", "s.rank"))).alias("n_copied"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of every whole text.

    spans has kind:start:end of all spans by start, then kind in the order assign, access, hex, pem, jwt, live;
    base_sha256 is the digest of the first three alone. n_copied counts spans whose value is a copied example. The
    owner is what stands before the first / of the repository. A null text is empty; a null repository is one of its
    own, with an owner without a name. Repeated rows stay and count once for a repository; other columns are not
    looked at.
    """
    found = cut(candidates(docs, id_col, text_col, repo_col))
    some, none = found.where(F.size("found") > 0), found.where(F.size("found") == 0)
    live = live_spans(some)
    live = live.withColumnsRenamed({"doc_id": "live_id", "text_key": "live_key"})
    joined = some.join(live, F.col("doc_id").eqNullSafe(F.col("live_id")) & (F.col("text_key") == F.col("live_key")))
    joined = joined.select("doc_id", "found", "live", "n_copied")
    span = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"
    every = joined.unionByName(none.select("doc_id", "found", empty(span).alias("live"), F.lit(0).cast("long").alias("n_copied")))
    plain = F.transform("found", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    base = F.filter(plain, lambda s: s["rank"] < len(KINDS))
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return every.select(
        "doc_id", *(count(kind) for kind, *_ in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.concat(plain, "live")).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_copied"
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """docs with every live span of the text replaced by MARK, and its length column, if there is one, brought up to date.

    Copied examples and all other text stay, as do null and empty texts, null ids, repeated rows and other columns
    under any name. Only rows that can hold a secret are joined with their spans; the others pass without a shuffle.
    """
    text = F.col(f"`{text_col}`")
    live_id, live_key, spans, clean_text = (fresh(name, docs.columns) for name in ("_live_id", "_live_key", "_live", "_clean"))
    clean, maybe = docs.where(~maybe_secret(text)), docs.where(maybe_secret(text))
    live = live_spans(cut(candidates(maybe, id_col, text_col, repo_col).where(F.size("found") > 0))).where(F.size("live") > 0)
    live = live.select(F.col("doc_id").alias(live_id), F.col("text_key").alias(live_key), F.col("live").alias(spans))
    joined = maybe.join(live, F.col(f"`{id_col}`").eqNullSafe(F.col(live_id)) & (F.xxhash64(text) == F.col(live_key)), "left")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(MARK))).alias("out"))

    state = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    cleaned = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    joined = joined.withColumn(clean_text, F.when(F.col(spans).isNotNull(), cleaned))
    changed = {text_col: F.coalesce(clean_text, text)}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col(clean_text).isNotNull(), F.length(clean_text).cast("long")).otherwise(F.col(f"`{chars_col}`"))
    return clean.unionByName(joined.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns)))
