"""Members, rosters and the search for a file across members of which some don't answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.functions.scalars import status_rank

MOST_HOPS = 4


def merge_rosters(rosters: DataFrame) -> DataFrame:
    """name, joined_at_s, status: of a member's copies the latest joined, then evicted before left before active, then the smallest status. One combining aggregate."""
    key = F.struct("joined_at_s", status_rank(F.col("status")).alias("rank"))
    best = rosters.groupBy("name", "status").agg(F.max(key).alias("k"))
    return best.groupBy("name").agg(F.max(F.struct("k", F.transform(F.split("status", ""), lambda c: -F.ascii(c)).alias("order"), "status")).alias("x")).select("name", F.col("x.k.joined_at_s").alias("joined_at_s"), F.col("x.status").alias("status"))


def federation_ids(rosters: DataFrame) -> DataFrame:
    """The distinct federation ids that aren't empty: more than one is an error of the input."""
    return rosters.select("fed_id").where("coalesce(fed_id, '') <> ''").distinct()


def active(roster: DataFrame) -> DataFrame:
    return roster.where("status = 'active'")


def signature(roster: DataFrame, by: str | None = None) -> DataFrame:
    """The members of a roster as text, name:status sorted and joined by commas."""
    g = roster.groupBy(by) if by else roster.groupBy()
    return g.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "status"))), ",").alias("signature"))


def divergent(rosters: DataFrame) -> DataFrame:
    """observer, divergent: whether an observer's copy says other than the merged roster."""
    one = signature(merge_rosters(rosters)).withColumnRenamed("signature", "merged")
    return signature(rosters, "observer").join(one, F.lit(True), "left").select("observer", (F.col("signature") != F.col("merged")).alias("divergent"))


def unregistered(roster: DataFrame, registry: DataFrame) -> DataFrame:
    return roster.join(registry.select("name"), "name", "left_anti")


def latest_forward(moves: DataFrame) -> DataFrame:
    """member, id, moved_to of the last completed move away, pending: whether a move is under way."""
    done = (F.col("state") == "done") & (F.coalesce("moved_to", F.lit("")) != "")
    return moves.groupBy("member", "id").agg(F.max_by(F.when(done, F.col("moved_to")), F.when(done, F.col("seq"))).alias("moved_to"), F.max(F.col("state") == "intent").alias("pending"))


def resolve(queries: DataFrame, held: DataFrame, moves: DataFrame, members: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """id, outcome, member, pointer for queries (id, home).

    Of the active members that answer, the home holds it: found-at-home; else the first by name that does: found-elsewhere. Else the pointers that answering members left
    are followed, first by name: the chain ends found, or partial-view where its next member is unknown or silent (pointer names it), or as error in a circle or after most_hops;
    a chain that ends at a member without the file says nothing. What members say of an id meets in one row, so there is one shuffle however many hops. Else partial-view if an active member is silent, or one has a move under way; else missing.
    """
    m = members.select(F.col("name").alias("member"), (F.col("status") == "active").alias("active"), "answered")
    known = members.agg(F.map_from_entries(F.collect_list(F.struct("name", "answered"))).alias("known"), F.coalesce(F.max((F.col("status") == "active") & ~F.col("answered")), F.lit(False)).alias("silent"))
    seen = held.select("member", "id", F.lit(True).alias("holds"), F.lit(None).cast("string").alias("moved_to"), F.lit(False).alias("pending")).unionByName(latest_forward(moves).withColumn("holds", F.lit(False)))
    views = seen.groupBy("id", "member").agg(F.max("holds").alias("holds"), F.max("moved_to").alias("moved_to"), F.max("pending").alias("pending")).join(m, "member").where("answered")
    by_id = views.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("member", F.struct("holds", "moved_to", "pending", "active")))).alias("views"))
    j = queries.select("id", "home").distinct().join(by_id, "id", "left").join(known, F.lit(True), "left")
    j = j.withColumn("now", F.filter(F.array_sort(F.map_entries("views")), lambda e: e["value"]["active"]))
    holders = F.transform(F.filter("now", lambda e: e["value"]["holds"]), lambda e: e["key"])
    starts = F.filter("now", lambda e: ~e["value"]["holds"] & e["value"]["moved_to"].isNotNull())
    chains = F.filter(F.transform(starts, lambda e: _chain(e, most_hops)), lambda c: c["end"] != "dead")
    j = j.withColumn("direct", F.when(F.array_contains(holders, F.col("home")), F.col("home")).otherwise(F.get(holders, F.lit(0)))).withColumn("c", F.when(F.col("direct").isNull(), F.get(chains, F.lit(0))))
    moving = F.exists("now", lambda e: ~e["value"]["holds"] & F.coalesce(e["value"]["pending"], F.lit(False)))
    who = F.coalesce("direct", F.when(F.col("c.end") == "found", F.col("c.dest")))
    outcome = F.when(who.isNotNull() & who.eqNullSafe(F.col("home")), "found-at-home").when(who.isNotNull(), "found-elsewhere").when(F.col("c.end") == "partial", "partial-view").when(F.col("c.end") == "error", "error").when(F.col("silent") | F.coalesce(moving, F.lit(False)), "partial-view").otherwise("missing")
    return j.select("id", outcome.alias("outcome"), who.alias("member"), F.when(F.col("c.end") == "partial", F.col("c.dest")).alias("pointer"))


def _chain(start: Column, most_hops: int) -> Column:
    """Struct of dest and end of the chain that leaves an entry of the id's views: found, partial, error or dead. It stays in the row: a file's members are few."""
    views, known = F.col("views"), F.col("known")

    def hop(s: Column, _: Column) -> Column:
        at = F.try_element_at(views, s["dest"])
        end = F.when(s["end"].isNotNull(), s["end"]).when(F.array_contains(s["seen"], s["dest"]), "error").when(~F.coalesce(F.try_element_at(known, s["dest"]), F.lit(False)), "partial").when(at["holds"], "found").when(at["moved_to"].isNull(), "dead")
        return F.struct(F.when(end.isNull(), at["moved_to"]).otherwise(s["dest"]).alias("dest"), F.concat(s["seen"], F.array(s["dest"])).alias("seen"), end.alias("end"))

    zero = F.struct(start["value"]["moved_to"].alias("dest"), F.array(start["key"]).alias("seen"), F.lit(None).cast("string").alias("end"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most_hops)), zero, hop, lambda s: F.struct(s["dest"].alias("dest"), F.coalesce(s["end"], F.lit("error")).alias("end")))


def heal(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, verdict, location of lock entries (path, id, location): at-home, healed (location is the new one), partial or missing; entries without an id are left out."""
    j = entries.where("coalesce(id, '') <> ''").join(resolved, "id")
    v = F.when(F.col("outcome").isin("found-at-home", "found-elsewhere"), F.when(F.col("member") == F.col("location"), "at-home").otherwise("healed")).when(F.col("outcome") == "missing", "missing").otherwise("partial")
    return j.select("path", v.alias("verdict"), F.when(v == "healed", F.col("member")).otherwise(F.col("location")).alias("location"))


def id_prefix(catalog: DataFrame, members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, n_ids, verdict, id: found, ambiguous, missing, or partial-view where an active member is silent. Prefixes of one length meet ids by equality of that many characters.

    Ids keep only the starts that are asked for, and those are counted before they meet a prefix, so a short prefix gathers no ids.
    """
    up = catalog.join(members.where("answered").select(F.col("name").alias("member")), "member", "left_semi").select("id").distinct()
    p = prefixes.select("prefix", F.length("prefix").alias("n")).distinct()
    lengths = p.where("n between 1 and 64").select("n").distinct()  # 64 rows at most
    keys = up.join(F.broadcast(lengths), F.length("id") >= F.col("n")).select("id", F.expr("substring(id, 1, n)").alias("key"))
    asked = p.select(F.lower("prefix").alias("key")).distinct()
    counted = keys.join(asked, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_ids"), F.min("id").alias("id"))
    hits = p.join(counted, F.lower("prefix") == F.col("key"), "left").select("prefix", F.coalesce("n_ids", F.lit(0).cast("long")).alias("n_ids"), "id")
    silent = members.agg(F.coalesce(F.max((F.col("status") == "active") & ~F.col("answered")), F.lit(False)).alias("silent"))
    v = F.when(F.col("n_ids") == 1, "found").when(F.col("n_ids") > 1, "ambiguous").when(F.col("silent"), "partial-view").otherwise("missing")
    return hits.join(silent, F.lit(True), "left").select("prefix", "n_ids", v.alias("verdict"), F.when(F.col("n_ids") == 1, F.col("id")).alias("id"))  # one row on the right


def collision(resolved: DataFrame) -> DataFrame:
    """id, verdict, member of ids that someone wants to restore, from resolve: collision where a member holds the id, refused where the view is partial or in error, ok where it is missing everywhere."""
    v = F.when(F.col("outcome").isin("found-at-home", "found-elsewhere"), "collision").when(F.col("outcome") == "missing", "ok").otherwise("refused")
    return resolved.select("id", v.alias("verdict"), F.when(v == "collision", F.col("member")).alias("member"))


def reach_tally(members: DataFrame) -> DataFrame:
    """n_answered, n_members, silent: of the active members how many answered, and the others' names in order."""
    m = active(members)
    return m.agg(F.count_if("answered").alias("n_answered"), F.count("*").alias("n_members"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("answered"), F.col("name")))), ", ").alias("silent"))


def probe(members: DataFrame, replies: DataFrame, within_ms: int) -> DataFrame:
    """members with answered: whether a reply (name, took_ms; null for none) came in time. Members that nobody asked haven't answered."""
    r = replies.where(F.col("took_ms") <= within_ms).select("name", F.lit(True).alias("a")).distinct()
    return members.drop("answered").join(r, "name", "left").withColumn("answered", F.coalesce("a", F.lit(False))).drop("a")


def load_roster(rosters: DataFrame, readable: DataFrame) -> DataFrame:
    """merge_rosters of the copies (observer) whose catalog could be read (readable: observer); the others don't count against it. More than one federation id among them is an error."""
    rows = rosters.join(readable.select("observer").distinct(), "observer", "left_semi")
    if "fed_id" in rosters.columns and len(ids := [r[0] for r in federation_ids(rows).limit(2).collect()]) > 1:
        raise ValueError(f"the copies name different federations: {', '.join(sorted(ids))}")
    return merge_rosters(rows)


def discover_roster(rosters: DataFrame, readable: DataFrame, via: str | None = None, joiner: str = "") -> DataFrame:
    """The roster to join: the copy of a sponsor (via), or all readable copies merged; the joiner's own copy doesn't count."""
    if via is not None:
        return rosters.where(F.col("observer") == via).select("name", "joined_at_s", "status")
    return load_roster(rosters.where(F.col("observer") != joiner), readable)


def roster_of_catalog(rosters: DataFrame, observer: str) -> DataFrame:
    """The members that a catalog's own federation table names, by name. A catalog without a federation id, or none, is an error."""
    rows = rosters.where((F.col("observer") == observer) & (F.coalesce("fed_id", F.lit("")) != ""))
    if not rows.take(1):
        raise ValueError(f"{observer} is in no federation")
    return rows.drop("observer").orderBy("name")


def roster_of_snapshot(snapshots: DataFrame, generation: int = 0) -> DataFrame:
    """name, node, status as a snapshot knew them; when they joined it doesn't know."""
    return snapshots.where(F.col("generation") == generation).select("name", "node", "status", F.lit(None).cast("long").alias("joined_at_s"))


def snapshot_pair(snapshots: DataFrame) -> DataFrame:
    """name, current, previous: each member's file count in the two generations kept; null where a generation doesn't have it."""
    of = lambda g: F.max(F.when(F.col("generation") == g, F.col("file_count"))).cast("long")
    return snapshots.where("generation < 2").groupBy("name").agg(of(0).alias("current"), of(1).alias("previous"))


def snapshot_of(catalog: DataFrame, members: DataFrame, taken_at_s: int, most: int | None = None) -> DataFrame:
    """name, status, taken_at_s, file_count, ids of the active members that answered: what a listing remembers. A member without files has none. ids: in order, one array a member, as snapshots hold them."""
    up = active(members).where("answered").select("name", "status")
    rows = catalog.groupBy(F.col("member").alias("name")).agg(F.count("*").alias("file_count"), F.sort_array(F.collect_list("id")).alias("ids"))
    return up.join(rows, "name", "left").select("name", "status", F.lit(taken_at_s).cast("long").alias("taken_at_s"), F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def live_or_cached(catalog: DataFrame, members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """member, id, path, cached: the files of active members that answer, and of those that don't the ids of the newest snapshot that has them, without paths."""
    up = active(members)
    live = catalog.join(up.where("answered").select(F.col("name").alias("member")), "member", "left_semi").select("member", "id", "path", F.lit(False).alias("cached"))
    known = last_known(snapshots).join(up.where("not answered").select("name"), "name", "left_semi")
    return live.unionByName(known.select(F.col("name").alias("member"), F.explode("ids").alias("id")).select("member", "id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("cached")))


def has_active(roster: DataFrame, names: DataFrame) -> DataFrame:
    """name, active: whether the roster has an active member of the name."""
    return names.join(active(roster).select("name", F.lit(True).alias("a")).distinct(), "name", "left").select("name", F.coalesce("a", F.lit(False)).alias("active"))


def node_of(roster: DataFrame, names: DataFrame) -> DataFrame:
    """name, node: empty for members that the roster doesn't know."""
    return names.join(roster.select("name", "node"), "name", "left").select("name", F.coalesce("node", F.lit("")).alias("node"))


def pending_roster_ops(wal: DataFrame, members: DataFrame) -> DataFrame:
    """name, n: roster operations under way in each member's log; 0 for one that doesn't answer."""
    n = wal.where("op_type = 'roster' and state = 'intent'").groupBy(F.col("member").alias("name")).agg(F.count("*").alias("n"))
    return members.join(n, "name", "left").select("name", F.when(F.col("answered"), F.coalesce("n", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n"))


def source(catalog: DataFrame, members: DataFrame, wanted: DataFrame, held: DataFrame, moves: DataFrame) -> DataFrame:
    """arg, id, verdict, member of what arguments name: `member/path` or the start of an id; then where the file is now. ambiguous, not-found and partial-view come from the prefix, other verdicts from resolve, whose live home wins over the member named."""
    from stratacat.functions.scalars import target

    t = wanted.select("arg", target(F.col("arg")).alias("t")).select("arg", "t.*")
    by_path = t.where("path is not null").join(catalog.select("member", "path", F.col("id").alias("found")), ["member", "path"], "left").select("arg", F.col("found").alias("of"), F.col("member").alias("home"), F.when(F.col("found").isNull(), "not-found").alias("early"))
    asked = t.where("path is null and coalesce(id, '') <> ''").select("arg", F.col("id").alias("prefix"))
    hit = id_prefix(catalog, members, asked.select("prefix").distinct()).select("prefix", F.col("id").alias("of"), F.when(F.col("verdict") == "missing", "not-found").when(F.col("verdict") != "found", F.col("verdict")).alias("early"))
    by_id = asked.join(hit, "prefix", "left").select("arg", "of", F.lit(None).cast("string").alias("home"), "early")
    none = t.where("path is null and coalesce(id, '') = ''").select("arg", F.lit(None).cast("string").alias("of"), F.lit(None).cast("string").alias("home"), F.lit("not-found").alias("early"))
    named = by_path.unionByName(by_id).unionByName(none)
    now = resolve(named.where("of is not null").groupBy(F.col("of").alias("id")).agg(F.min("home").alias("home")), held, moves, members)
    j = named.join(now.select(F.col("id").alias("of"), "outcome", "member"), "of", "left")
    return j.select("arg", F.col("of").alias("id"), F.coalesce("early", "outcome").alias("verdict"), "member")


def resolve_entries(entries: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    """path, member, warning of lock entries (path, id, location) with what resolve says of their ids: where to fetch from; entries without an id come from their location. moved where that is elsewhere, home-<status> where the location is no active member; unresolved has no member."""
    r = resolved.select("id", "outcome", F.col("member").alias("at"))
    home = members.select(F.col("name").alias("location"), F.col("status").alias("home_status"))
    j = entries.select("path", F.nullif("id", F.lit("")).alias("id"), "location").join(r, "id", "left").join(home, "location", "left")
    member = F.when(F.col("id").isNull(), F.col("location")).otherwise(F.col("at"))
    w = F.when(member.isNull(), F.concat(F.lit("unresolved-"), F.coalesce("outcome", F.lit("unknown")))).when(F.col("home_status") != "active", F.concat(F.lit("home-"), F.col("home_status"))).when(member != F.col("location"), "moved")
    return j.select("path", member.alias("member"), w.alias("warning"))


def fan_out(targets: DataFrame) -> DataFrame:
    """name, result of a roster write to targets (name, answered, permitted): applied, or pending where one doesn't answer; refused for all that answer if any of these doesn't permit it, before any is written."""
    barred = targets.agg(F.coalesce(F.bool_or(F.col("answered") & ~F.col("permitted")), F.lit(False)).alias("barred"))
    return targets.join(barred, F.lit(True), "left").select("name", F.when(~F.col("answered"), "pending").when(F.col("barred"), "refused").otherwise("applied").alias("result"))  # one row on the right


def totals(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("member").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def listing(catalog: DataFrame, members: DataFrame, member: str | None = None, prefix: str = "") -> DataFrame:
    """member, path, logical_path, sync_mode, size of the active members that answer, by member and path prefix."""
    rows = catalog.join(active(members).where("answered").select(F.col("name").alias("member")), "member", "left_semi")
    rows = rows.where(F.col("path").startswith(prefix)) if prefix else rows
    rows = rows.where(F.col("member") == member) if member else rows
    return rows.select("member", "path", F.concat_ws("/", "member", "path").alias("logical_path"), "sync_mode", "size")


def last_known(snapshots: DataFrame) -> DataFrame:
    """Each member's row of the newest of the two generations kept."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("generation"))
    return snapshots.where("generation < 2").withColumn("rank", rank).where("rank = 1").drop("rank")


def last_known_holders(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """id, name, generation of the member that the newest of the two kept generations knows to hold each of ids (id); of several the first by name. snapshots: with the array ids."""
    held = snapshots.where("generation < 2").select("name", "generation", F.explode("ids").alias("id")).join(ids.select("id").distinct(), "id", "left_semi")
    return held.groupBy("id").agg(F.min(F.struct("generation", "name")).alias("x")).select("id", "x.name", "x.generation")


def online(peers: DataFrame) -> DataFrame:
    """name, dns of the peers that are online."""
    return peers.where("online").select("name", "dns")


def rotate(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """new becomes generation 0, what was there moves one back, and only two stay."""
    return new.withColumn("generation", F.lit(0)).unionByName(snapshots.withColumn("generation", F.col("generation") + 1).where("generation < 2"))


def status(members: DataFrame, pending: DataFrame, catalog: DataFrame, snapshots: DataFrame) -> DataFrame:
    """name, status, reachable, n_pending, n_files: live counts of members that answer, else the last that is known (cached)."""
    p = pending.groupBy(F.col("member").alias("name")).agg(F.count("*").alias("p"))
    t = totals(catalog).select(F.col("member").alias("name"), "n_files")
    s = last_known(snapshots).select("name", F.col("file_count").cast("long").alias("known"))
    j = members.join(p, "name", "left").join(t, "name", "left").join(s, "name", "left")
    return j.select("name", "status", F.col("answered").alias("reachable"), F.when(F.col("answered"), F.coalesce("p", F.lit(0))).alias("n_pending"), F.when(F.col("answered"), F.coalesce("n_files", F.lit(0))).otherwise(F.col("known")).alias("n_files"), (~F.col("answered") & F.col("known").isNotNull()).alias("cached"))


def worst_exit(outcomes: DataFrame, code: Column) -> DataFrame:
    return outcomes.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def fetch_plan(resolved: DataFrame, catalog: DataFrame, objects: DataFrame) -> DataFrame:
    """id, member, verdict of resolved files: not-found, no-bytes, ok, or for other bytes than recorded drifted (files that git doesn't keep may change) or corrupt."""
    c = catalog.select("id", "member", "sha256", "sync_mode")
    j = resolved.select("id", "member", "outcome").join(c, ["id", "member"], "left").join(objects.select(F.col("object_key").alias("sha256"), "observed_sha"), "sha256", "left")
    v = F.when(F.col("sync_mode").isNull(), "not-found").when(F.col("observed_sha").isNull(), "no-bytes").when(F.col("observed_sha") == F.col("sha256"), "ok").when(F.col("sync_mode") == "git", "corrupt").otherwise("drifted")
    return j.select("id", "member", v.alias("verdict"))
