"""Conversations from message rows: sessions by channel, turns in order with roles, unsound ones dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed

#: Spellings of the four roles, letters only (fixed values).
ROLES = {
    "user": ("user", "human", "person", "customer", "enduser", "usr", "client", "prompter"),
    "assistant": ("assistant", "ai", "model", "bot", "agent", "gpt", "llm", "chatbot", "asst", "aiassistant"),
    "system": ("system", "sys", "developer", "instruction", "instructions"),
    "tool": ("tool", "function", "toolresult", "tooluse", "toolcall", "functioncall", "functionresult", "toolresponse", "observation"),
}
_UNSEEN = r"\s\p{Z}\x{85}\x{1C}-\x{1F}\x{AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
#: A session with more than this share of all rows, and more rows than a slice, is cut into slices of time that hold about so many rows.
HOT_SHARE, SLICE_ROWS, MOST_SLICES = 0.002, 200_000, 1000
#: Heavy sessions looked for, and the counters of the sketch that finds them: what it may miss is below 3.5 / counters of all rows.
HOT_SESSIONS, HOT_COUNTERS = 200, 4096
#: Depths of messages of one instant are broadcast up to so many (some 60 bytes each), joined beyond.
MOST_TIES_SENT = 200_000
#: A shorter pause never splits a session.
LEAST_GAP_SECONDS = 1800
#: Log pauses are counted in bins, so many to a factor of e; the valley between two modes: bins it has at least, and their share of what lies beyond.
BINS_A_UNIT, VALLEY_BINS, VALLEY_SHARE = 4, 4, 0.01


def role_number(raw: Column) -> Column:
    """The role's place in ``_ROLE_NAMES``, null if no spelling of one."""
    known = {spelling: _ROLE_NAMES.index(name) for name, spellings in ROLES.items() for spelling in spellings}
    place = F.array_position(F.array(*map(F.lit, known)), F.regexp_replace(F.lower(raw), "[^a-z]", ""))
    return F.try_element_at(F.array(*map(F.lit, known.values())), F.when(place > 0, place.cast("int")))


_PLAIN_TIME = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)\z"


def _odd_instant(raw: Column) -> Column:
    text = F.upper(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    iso = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d+)?)?\s?(Z|UTC|[+-]\d\d(:?\d\d)?)?$") & ~text.startswith("0000")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ",", "."), r"\s?(Z|UTC)$", "Z"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    plain = F.regexp_replace(plain, r"(:\d\d(?:\.\d+)?)\s?([+-]\d\d)$", "$1$2:00")
    zoned = F.when(plain.rlike(r"(Z|[+-]\d\d:\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    epoch = text.rlike(r"^\d{11,14}(\.0+)?$")
    return F.when(epoch, F.regexp_extract(text, r"^\d+", 0).cast("bigint") * 1000).when(iso, F.unix_micros(zoned.try_cast("timestamp")))


def instant_micros(raw: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 date and time (UTC if it has no zone) or of epoch milliseconds; null if not real.

    The usual spellings are told by one pattern each; only others go through the steps that bring them to it. Those stand in a lambda, which
    keeps them out of the generated method: with them it grows beyond what the JVM compiles, and every row costs ten times as much.
    """
    usual = F.when(raw.rlike(_PLAIN_TIME) & ~raw.startswith("0000"), F.unix_micros(raw.try_cast("timestamp"))).when(raw.rlike(r"\A\d{11,14}\z"), raw.try_cast("bigint") * 1000)
    return usual.otherwise(F.element_at(F.transform(F.array(raw), _odd_instant), 1))


_UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_OTHER = 17
#: Bits of a message's flags.
_KNOWN, _VISIBLE, _UNSOUND = 1, 2, 4
#: Roles by number, in alphabetical order, as the least counts where copies differ.
_ROLE_NAMES = ("assistant", "system", "tool", "user")
_ASSISTANT, _USER = 0, 3


def packed(text: Column) -> Column:
    """A key in few bytes, different for different texts: 16 for a UUID in lower case, else 17 zeros and the text."""
    return F.when(text.rlike(_UUID), F.unhex(F.translate(text, "-", ""))).otherwise(F.concat(F.unhex(F.lit("00" * _OTHER)), F.encode(text, "utf-8")))


def unpacked(key: Column) -> Column:
    h = F.lower(F.hex(key))
    dashed = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.length(key) == 16, dashed).otherwise(F.substring(key, _OTHER + 1, 2**31 - 1).cast("string"))


def session_key(raw: Column) -> Column:
    return F.when(raw.rlike(_UUID), raw).otherwise(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")))


def messages(rows: DataFrame) -> DataFrame:
    """One row a message (s, u: packed session and uuid): role, instant, flags, and the least and greatest hash of its parents.

    Each row goes out as a message under its own uuid and as a reference under its parent's, so that one aggregation both puts copies
    together and tells whether every parent is there and precedes its children. A parent that is no message comes out as an unsound row.
    """
    trimmed, uuid = session_key(F.col("session_id")), F.when(F.col("msg_uuid").rlike(r"\S"), F.col("msg_uuid"))
    base = rows.select(trimmed.alias("s"), uuid.alias("u"), F.col("parent_uuid").alias("p"), role_number(F.col("msg_role")).alias("role"), instant_micros(F.col("msg_timestamp")).alias("instant"), F.coalesce(F.col("msg_text").rlike(f"[^{_UNSEEN}]"), F.lit(False)).alias("visible"))
    unsound = F.col("u").isNull() | F.col("role").isNull() | F.col("instant").isNull() | F.coalesce(F.col("p") == F.col("u"), F.lit(False))
    flags = F.lit(_KNOWN) + F.when(F.col("visible"), _VISIBLE).otherwise(0) + F.when(unsound, _UNSOUND).otherwise(0)
    base = base.filter("s <> ''").select(packed(F.col("s")).alias("s"), packed(F.col("u")).alias("u"), packed(F.col("p")).alias("p"), "role", "instant", flags.alias("flags"))
    own = F.struct("u", "role", "instant", "flags", F.xxhash64("p").alias("parent"), F.lit(None).cast("bigint").alias("child"))
    own = F.when(F.col("p").isNull(), own.withField("parent", F.lit(None).cast("bigint"))).otherwise(own)
    of_parent = F.struct(F.col("p").alias("u"), F.lit(None).cast("int").alias("role"), F.lit(None).cast("bigint").alias("instant"), F.lit(0).alias("flags"), F.lit(None).cast("bigint").alias("parent"), F.col("instant").alias("child"))
    both = base.select("s", F.explode(F.when(F.col("p").isNull(), F.array(own)).otherwise(F.array(own, of_parent))).alias("x")).select("s", "x.*")
    m = both.groupBy("s", "u").agg(F.min("role").alias("role"), F.min("instant").alias("instant"), F.bit_or("flags").alias("flags"), F.min("parent").alias("low"), F.max("parent").alias("high"), F.min("child").alias("child"))
    orphan = (F.col("flags").bitwiseAND(_KNOWN) == 0) | F.coalesce(F.col("instant") > F.col("child"), F.lit(False))
    return m.select("s", "u", F.col("role").cast("byte").alias("role"), "instant", F.when(orphan, F.col("flags").bitwiseOR(_UNSOUND)).otherwise(F.col("flags")).cast("byte").alias("flags"), "low", "high")


def hot_sessions(rows: DataFrame, slice_rows: int, share: float = HOT_SHARE) -> DataFrame | None:
    """(s, cuts): sessions with a large share of all rows and the instants that cut them into slices; None without any.

    A sketch of bounded size finds them, so the table has HOT_SESSIONS rows at most.
    """
    key = rows.select(session_key(F.col("session_id")).alias("s"))
    top = key.agg(F.expr(f"approx_top_k(s, {HOT_SESSIONS}, {HOT_COUNTERS})").alias("top"), F.count("*").alias("n")).first()
    hot = {x["item"]: x["count"] for x in top["top"] or [] if x["item"] and x["count"] > max(slice_rows, share * top["n"])}
    if not hot:
        return None
    pieces = {s: min(MOST_SLICES, -(-n // slice_rows)) for s, n in hot.items()}
    most = max(pieces.values())
    of = rows.select(session_key(F.col("session_id")).alias("s"), instant_micros(F.col("msg_timestamp")).alias("instant")).filter(F.col("s").isin(*hot))
    grid = of.groupBy("s").agg(F.percentile_approx("instant", [i / most for i in range(1, most)], 20 * most).alias("cuts")).collect()
    spark = rows.sparkSession
    made = spark.createDataFrame([(r.s, sorted(set(r.cuts or []))) for r in grid], "s string, cuts array<bigint>")
    return made.select(packed(F.col("s")).alias("s"), "cuts")


def _tie_depths(tied: DataFrame) -> DataFrame | None:
    """(s, u, depth, circle) of messages whose parent has the same instant: depth below the first of the instant, by pointer doubling.

    log2(longest chain) rounds over the ties only. A message on a circle of equal instants has circle set: none of it precedes its child.
    Where copies name two parents of the same instant, the greater one orders it. None without any such message.
    """
    child = tied.select("s", "u", "instant", F.explode(F.array_distinct(F.filter(F.array("low", "high"), lambda x: x.isNotNull()))).alias("h"))
    above = tied.select("s", F.col("u").alias("up"), "instant", F.xxhash64("u").alias("h"))
    edges = checkpointed(child.join(above, ["s", "instant", "h"]).groupBy("s", "u").agg(F.max("up").alias("up"), F.lit(1).cast("bigint").alias("depth")))
    n = left = edges.count()
    if not n:
        return None
    while left:
        up = edges.select("s", F.col("u").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        edges = checkpointed(edges.join(up, ["s", "up"], "left").select("s", "u", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        # each round ends some message of every open chain, so one that ends none has circles left only
        before, left = left, edges.filter("up is not null").count()
        if left == before:
            break
    out = edges.select("s", "u", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("circle"))
    return F.broadcast(out) if n <= MOST_TIES_SENT else out


def pauses(turns: DataFrame) -> DataFrame:
    """Every pause of a session (microseconds): those inside the slices, and from each slice's end to the next one's begin."""
    edges = turns.groupBy("s", "slice").agg(F.min("instant").alias("begin"), F.max("instant").alias("end"))
    jump = F.col("begin") - F.lag("end").over(Window.partitionBy("s").orderBy("slice"))
    return turns.select("pause").unionByName(edges.select(jump.alias("pause"))).filter("pause is not null")


def valley(bins: dict[int, int]) -> float | None:
    """The middle of the lowest valley above the median of a histogram (bin -> count), in bins; None if it has none.

    A valley is a run of at least VALLEY_BINS bins, each with under VALLEY_SHARE of what lies beyond it, so that neither stray pauses
    in it nor a lone one far above move it.
    """
    beyond, below, n, run = sum(bins.values()), 0, sum(bins.values()), 0
    for b in range(min(bins), max(bins) + 1) if bins else ():
        k = bins.get(b, 0)
        beyond -= k
        thin = 2 * below >= n and k <= VALLEY_SHARE * beyond
        if not thin and run >= VALLEY_BINS:
            return b - run / 2
        run, below = run + 1 if thin else 0, below + k
    return None


def calibrated_gap(turns: DataFrame, least_seconds: int = LEAST_GAP_SECONDS, reach: float = 3.0) -> float:
    """Seconds of silence that end a stretch of talk: between the modes of the log pauses of all sessions, slice edges included.

    Pauses that show no second mode (see ``valley``) are taken by the upper fence of their log distribution.
    """
    log = F.log(F.col("pause") / 1e6)
    positive = pauses(turns).filter("pause > 0")
    at = valley({r.bin: r.n for r in positive.groupBy(F.floor(log * BINS_A_UNIT).alias("bin")).agg(F.count("*").alias("n")).collect()})
    if at is not None:
        return max(float(least_seconds), math.exp(at / BINS_A_UNIT))
    q = positive.select(F.percentile_approx(log, [0.25, 0.75], 1000).alias("q")).first().q
    return max(float(least_seconds), math.exp(q[1] + reach * (q[1] - q[0]))) if q else float(least_seconds)


def conversations(rows: DataFrame, gap_seconds: float | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The turns of every sound conversation: session_id, turn (from 0), segment, msg_uuid, role, instant (microseconds).

    A session is one channel; its messages go by instant, at equal instants parent before child, and then by msg_uuid. Dropped are
    sessions with a row that lacks msg_uuid, role or instant, with a parent that doesn't precede its child (a circle of equal
    instants included), and sessions whose user and assistant turns are none, don't begin with user, or hold a user turn
    not followed by an assistant's. Rows with a null or blank session_id belong to none. Repeated rows count once; where copies of
    one message differ, the least instant and role count, and the parents of all copies must precede it. Invisible messages may be
    parents but are no turns; an empty table gives no turns; extra columns are ignored. Turns are numbered through and carry the ``segment``
    they fall in: a pause above ``gap_seconds`` begins a new one (a segment is no conversation of its own). The gap is calibrated on
    all pauses if it is None; with infinity a session is one segment.

    A session that holds a large share of all rows is cut into slices of time (``slice_rows`` each, some more for equal instants): slices are
    sorted alone, and their counts, first and last roles are put together per session, so no task holds a whole hot session.
    """
    m, hot = messages(rows), hot_sessions(rows, slice_rows)
    if hot is None:
        keys, m = ["s"], m.withColumn("slice", F.lit(0))
    else:
        keys, m = ["s", "slice"], m.join(F.broadcast(hot), "s", "left").withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("instant"))), F.lit(0))).drop("cuts")
    by_time = Window.partitionBy(*keys).orderBy("instant", "u")
    peer = (F.lag("instant").over(by_time) == F.col("instant")) | (F.lead("instant").over(by_time) == F.col("instant"))
    m = checkpointed(m.repartition(*keys).withColumn("tied", F.coalesce(peer, F.lit(False))))
    depths = _tie_depths(m.filter(F.col("tied") & F.col("u").isNotNull()))
    m = m.drop("low", "high", "tied")
    if depths is None:
        m = m.withColumn("depth", F.lit(0).cast("bigint"))
    else:
        m = m.join(depths, ["s", "u"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("flags", F.when(F.col("circle"), F.col("flags").bitwiseOR(_UNSOUND)).otherwise(F.col("flags"))).drop("circle")
    visible, bad = F.col("flags").bitwiseAND(_VISIBLE) != 0, F.col("flags").bitwiseAND(_UNSOUND) != 0
    within = Window.partitionBy(*keys).orderBy("instant", "depth", "u")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    speaker = F.when(visible & F.col("role").isin(_ASSISTANT, _USER), F.col("role"))
    m = m.withColumn("visible", visible).withColumn("speaker", speaker)
    turns = m.select(
        "*", F.row_number().over(within).alias("at"), F.coalesce(F.sum(F.col("visible").cast("int")).over(before), F.lit(0)).alias("nth"), F.last("speaker", ignorenulls=True).over(before).alias("spoke"),
        F.when(F.col("visible"), F.col("instant") - F.last(F.when(F.col("visible"), F.col("instant")), ignorenulls=True).over(before)).alias("pause"),
    )
    gap = calibrated_gap(turns.filter("visible")) if gap_seconds is None else gap_seconds
    micros = F.lit(float(gap) * 1e6)
    breaks = F.coalesce(F.col("pause") > micros, F.lit(False))
    said = F.when(F.col("speaker").isNotNull(), F.col("at"))
    seen = F.when(F.col("visible"), F.col("instant"))
    slices = turns.groupBy("s", "slice").agg(
        F.count_if("visible").alias("n"), F.max((F.col("speaker") == _USER) & F.coalesce(F.col("spoke") == _USER, F.lit(False))).alias("unanswered"), F.min_by("speaker", said).alias("first"), F.max_by("speaker", said).alias("last"),
        F.count_if(breaks).alias("n_breaks"), F.min(seen).alias("begin"), F.max(seen).alias("end"), F.max(bad).alias("unsound"),
    )
    along = Window.partitionBy("s").orderBy("slice")
    earlier, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("s")
    jump = F.coalesce((F.col("begin") - F.last("end", ignorenulls=True).over(earlier)) > micros, F.lit(False))
    slices = slices.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("came", F.last("last", ignorenulls=True).over(earlier)).withColumn("jump", jump.cast("int"))
    slices = slices.withColumn("segments", F.sum("jump").over(along) + F.coalesce(F.sum("n_breaks").over(earlier), F.lit(0)))
    broken = F.col("unsound") | F.coalesce(F.col("unanswered"), F.lit(False)) | F.coalesce((F.col("first") == _USER) & (F.col("came") == _USER), F.lit(False))
    slices = slices.withColumn("broken", F.max(broken).over(whole)).withColumn("opens", F.min_by("first", F.when(F.col("first").isNotNull(), F.col("slice"))).over(whole)).withColumn("closes", F.max_by("last", F.when(F.col("last").isNotNull(), F.col("slice"))).over(whole))
    sound = slices.filter((~F.col("broken")) & (F.col("opens") == _USER) & (F.col("closes") == _ASSISTANT)).select(*keys, "offset", "segments")
    out = turns.withColumn("segment", F.sum(breaks.cast("int")).over(within)).filter("visible").join(sound, keys)
    names = F.array(*map(F.lit, _ROLE_NAMES))
    return out.select(unpacked(F.col("s")).alias("session_id"), (F.col("offset") + F.col("nth")).cast("int").alias("turn"), (F.col("segments") + F.col("segment")).cast("int").alias("segment"), unpacked(F.col("u")).alias("msg_uuid"), F.element_at(names, F.col("role").cast("int") + 1).alias("role"), "instant")


def with_texts(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Turns with the fullest text among the copies of each message, and its model."""
    fullest = F.max(F.struct(F.length("msg_text").alias("n"), F.col("msg_text")))["msg_text"]
    texts = rows.select(session_key(F.col("session_id")).alias("session_id"), "msg_uuid", "msg_text", "model").groupBy("session_id", "msg_uuid").agg(fullest.alias("msg_text"), F.max("model").alias("model"))
    return turns.join(texts, ["session_id", "msg_uuid"], "left").select("session_id", "turn", "segment", "role", "msg_uuid", F.timestamp_micros("instant").alias("said_at"), "msg_text", "model")


def found(rows: DataFrame) -> DataFrame:
    """The turns of sound conversations; the gap is infinite, as a session is one conversation."""
    return conversations(rows, gap_seconds=math.inf).select("session_id", "turn", "msg_uuid")
