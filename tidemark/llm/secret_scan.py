"""Secret scans by corpus-wide ownership frequency. Built-in expressions only.

Candidates are strings that look like credentials: values of password-like assignments, access key ids, long hex runs, and bare runs of mixed
letters and digits. Their hashes are aggregated over the corpus by distinct repository and distinct owner. A string that many owners carry is a
copied example; one that stays with few owners, and looks real, is taken for live. Bare runs become spans of their own only if the corpus says they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The base patterns. The letters of ``assign`` match in either case (ASCII only, as Java does by default).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "live"]
#: Bare runs: at least ``min_length`` of these.
RUN_CHARS = "[A-Za-z0-9+/_=-]"
#: What a text with a base span, or with a bare run, must contain somewhere.
BASE_HINT = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
MIXED = "[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"


#: Matches whose places are summed in one growing array.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, rank: int, least: int, value=lambda m: m) -> Column:
    """Array of (start, rank, end, value) of the leftmost non-overlapping matches whose value has ``least`` characters; end exclusive.

    Texts between matches and the matches themselves alternate, so starts are running sums of their lengths. They are taken in blocks: an array that
    grows by one is copied each time, which only stays cheap while it is short, so twice as many matches take twice as long.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    kind = "array<struct<start:int,rank:int,end:int,value:string>>"

    def walk(block, first):
        start = F.struct(first.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(block, start, lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + s["gap"] + s["size"]).alias("end"),
                                                  value(s["match"]).alias("value")))).alias("out")), lambda acc: acc["out"])

    def blocks(m, g):
        step = F.transform(m, lambda x, k: F.struct(F.element_at(g, k + 1).alias("gap"), F.length(x).alias("size"), x.alias("match")))
        cut = let(step, lambda all_: F.transform(F.sequence(F.lit(0), (F.size(all_) - 1).cast("int"), F.lit(BLOCK)), lambda k: F.slice(all_, k + 1, BLOCK)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["size"])
        firsts = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + length(block))))
        return let(cut, lambda bs: let(firsts(bs), lambda at: F.flatten(F.transform(bs, lambda block, k: walk(block, at[k])))))

    out = let(found, lambda m: F.when(F.size(m) > 0, let(gaps, lambda g: blocks(m, g))).otherwise(F.array().cast(kind)))
    return F.filter(out, lambda s: F.length(s["value"]) >= least)


def base_spans(text: Column) -> list[Column]:
    """Base spans of kinds assign, access and hex. Runs below the least length never matter for access and hex, so their patterns ask for it."""
    return [spans(text, ASSIGN, 0, 6, lambda m: F.regexp_replace(m, ASSIGN_HEAD, "")),
            spans(text, "AKIA[A-Z0-9]{16,}", 1, 20), spans(text, "[0-9a-f]{24,}", 2, 24)]


def may_match(text: Column, min_length: int) -> Column:
    return text.rlike(BASE_HINT) | (text.rlike(MIXED) & text.rlike(RUN_CHARS + "{%d}" % min_length))


def candidates(docs: DataFrame, repo: str, owner: str, min_length: int, min_distinct: int) -> DataFrame:
    """(doc_id, repo, owner, spans): all base spans and bare runs of a text with the hash of each value; one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    may, bare, mixed = text.rlike(BASE_HINT), RUN_CHARS + "{%d,}" % min_length, text.rlike(MIXED) & text.rlike(RUN_CHARS + "{%d}" % min_length)
    base = F.when(may, F.concat(*base_spans(text))).otherwise(none)
    runs = F.when(mixed, spans(text, bare, 3, min_length)).otherwise(none)
    varied = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= min_distinct)
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["rank"], s["end"], F.substring(F.sha2(s["value"], 256), 1, 32).alias("hash"),
                                                         varied(s["value"]).alias("varied")))
    every = F.filter(hashed(F.concat(base, runs)), lambda s: (s["rank"] < 3) | s["varied"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repo).cast("string").alias("repo") if isinstance(repo, str) else repo.alias("repo"),
                       F.col(owner).cast("string").alias("owner") if isinstance(owner, str) else owner.alias("owner"), every.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_docs) over the corpus, folded before each shuffle. A null owner or repository counts as one of its own."""
    one = found.select("doc_id", "repo", "owner", F.explode("spans").alias("s")).select("doc_id", "repo", "owner", "s.hash")
    return (one.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
            .groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
            .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found")))


def secret_scan(docs: DataFrame, *, repo="source", owner="source", max_owners: int = 2, max_repos: int = 4, min_length: int = 16, min_distinct: int = 8) -> DataFrame:
    """One row per document: doc_id, found (array of start, kind, end, hash, n_owners, n_repos, n_found, live), sorted by start and kind.

    ``repo`` and ``owner`` are columns or their names. A value looks real if it has a digit, a letter and ``min_distinct`` different
    characters; it is live if it looks real and at most ``max_owners`` owners and
    ``max_repos`` repositories carry it, else an example. Base
    spans (assign, access, hex) are always kept; bare runs are kept, as kind ``live``, if their value is live and no base span of the text
    overlaps them. Null and empty texts have no spans; a null owner or repository is one more owner or repository. Rows that repeat a doc_id stay
    apart. Other columns are ignored; an empty table gives an empty table.
    """
    own = materialise(candidates(docs, repo, owner, min_length, min_distinct).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = own.where(F.size("spans") > 0)
    stats = materialise(ownership(some), "ownership")
    each = some.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.rank", "s.end", "s.hash", "s.varied")
    live = F.col("varied") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    # a bare run overlaps a base span that starts before it and ends behind its start, or one that starts inside it
    by, base = Window.partitionBy("row").orderBy("start", "rank"), F.col("rank") < 3
    left = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))  # frames that end at the last row would be summed anew for each row
    right = F.last(F.when(base, F.col("start")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(left, F.lit(0)) <= F.col("start")) & (right.isNull() | (right >= F.col("end")))
    judged = (each.join(stats, "hash").withColumns({"live": live, "clear": clear}).where(base | (F.col("live") & F.col("clear")))
              .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "hash", "n_owners", "n_repos", "n_found", "live"))).alias("all")))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda s: F.struct(s["start"].alias("start"), kinds[s["rank"]].alias("kind"), s["end"].alias("end"), s["hash"].alias("hash"),
                               s["n_owners"].alias("n_owners"), s["n_repos"].alias("n_repos"), s["n_found"].alias("n_found"), s["live"].alias("live"))
    kept = judged.select("row", F.transform("all", named).alias("found"))
    none = F.array().cast(kept.schema["found"].dataType)
    return own.select("row", "doc_id").join(kept, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and the text of all spans, from ``secret_scan``'s rows."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                          F.sha2(text(F.filter("found", lambda s: s["kind"] != "live")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
                          F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
                          F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_examples"))


def blank_live(docs: DataFrame, *, mark: str = "[secret]", min_length: int = 16, **options) -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; ``n_chars``, where there is one, is counted anew for changed texts.

    Texts without any candidate pass without a shuffle; the others meet their live spans by a hash of id and text, so rows that repeat a doc_id with
    another text are blanked by their own spans. Null texts pass.
    """
    keep = docs.columns
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    may = F.coalesce(may_match(F.col("text"), min_length), F.lit(False))
    scanned = secret_scan(docs.where(may).select(key.alias("doc_id"), *[c for c in keep if c != "doc_id"]), min_length=min_length, **options)
    live = scanned.select(F.col("doc_id").alias("key"), F.transform(F.filter("found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    live = materialise(live.where(F.size("spans") > 0).dropDuplicates(["key"]), "live")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    old = F.col("doc")["text"]

    def step(acc, s):
        new = F.concat(acc["out"], old.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out")))

    blanked = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], old.substr(acc["at"] + 1, F.length(old))))
    packed = docs.where(may).select(F.struct("*").alias("doc"), key.alias("key"))  # other columns cannot clash
    changed = packed.join(live, "key", "left").select("doc", F.col("spans").isNotNull().alias("hit"), F.when(F.col("spans").isNotNull(), blanked).otherwise(old).alias("text"))
    new = {c: F.col("doc")[c] for c in keep} | {"text": F.col("text")}
    if "n_chars" in keep:
        new["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    return docs.where(~may).unionByName(changed.select(*[new[c].alias(c) for c in keep]))
