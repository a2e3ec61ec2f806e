"""Secret scans with corpus-wide ownership frequency.

Every text is scanned whole for three base kinds (assign, access, hex) and for opaque tokens, the candidates that
the method judges. Candidate values are hashed and counted by the distinct owners and repositories that hold
them: a value that several owners hold, or that lies in many repositories, is a widely copied example; a value of one owner
and few repositories looks live, and its opaque tokens are added under the kind ``owned``. Base spans stay whatever their
counts; the counts are their verdict.

Defined cases: a null or empty text has no spans; a null owner or repository is a value of its own; rows that
repeat a document are scanned and returned one by one (counts are of distinct owners and repositories, so copies inside one
don't matter); an empty table gives an empty result; other columns of the input are ignored, and kept by ``redact_secrets``
whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import keep, small_batches, unused

#: The kinds in their order, and the base patterns.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: An opaque token: a maximal run of 20 or more of these, judged by ``opaque``.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "api")

SCAN = "row_id long, text_key long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, spans array<struct<kind:int,start:int,end:int,value:binary>>"


def opaque(run: str) -> bool:
    """Whether a run could be a random credential: lower and upper letters and digits, two of each at least."""
    return sum(map(str.isdigit, run)) > 1 and sum("a" <= c <= "z" for c in run) > 1 and sum("A" <= c <= "Z" for c in run) > 1


def find_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; kinds are numbered as in KINDS. Code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    at, reach = 0, 0  # of the base spans that begin before a run's end, the largest end
    for m in RUN.finditer(text):
        if opaque(m[0]):
            while at < len(base) and base[at][0] < m.end():
                reach = max(reach, base[at][2])
                at += 1
            if reach <= m.start():
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _scan(batches):
    for b in batches:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans")}
        for text in b.column("text").to_pylist():
            spans = find_spans(text or "")
            n = [0, 0, 0, 0]
            for _, k, _, _ in spans:
                n[k] += 1
            out["n_assign"].append(n[0])
            out["n_access"].append(n[1])
            out["n_hex"].append(n[2])
            out["base"].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k < 3))
            out["spans"].append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).digest()} for s, k, e, v in spans])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
        cols = {k: b.column(k) for k in ("row_id", "text_key", "doc_id", "owner", "repo")}
        cols |= {k: pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")} | {"base": pa.array(out["base"], pa.string()), "spans": pa.array(out["spans"], kind)}
        yield pa.RecordBatch.from_pydict(cols)


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One row per document row with its spans; written once, so that row_id is stable and texts are read once."""
    narrow = docs.select(F.col("doc_id").cast("long"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col("text").cast("string"), _text_key().alias("text_key"))
    with small_batches(docs.sparkSession):
        return keep(narrow.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_scan, SCAN), "secret-scan")


def _text_key() -> Column:
    """Brings a row and its spans together. Rows that share a key share only values, and what a value is holds for all."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_owners, n_repos: three counts on shrinking groups, each combined before its shuffle."""
    held = scanned.where("size(spans) > 0").select("owner", "repo", F.explode("spans.value").alias("value"))
    repos = held.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("value", "owner").agg(F.count("one").alias("r"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repos"))


#: Owners and repositories that a live-looking value has at most.
MAX_OWNERS, MAX_REPOS = 1, 2


def _live(max_owners: int, max_repos: int) -> Column:
    return (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)


def judged_spans(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per span: row_id, doc_id, kind, start, end, value, n_owners, n_repos, verdict (live or example)."""
    rows = scanned.where("size(spans) > 0").select("row_id", "doc_id", F.inline("spans"))
    held = keep(ownership(scanned), "ownership")  # read again, so that the join can split a hot value
    return rows.join(held, "value").withColumn("verdict", F.when(_live(max_owners, max_repos), "live").otherwise("example"))


def find_secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document row: doc_id, counts of base spans, ``base`` and ``spans`` as text (kind:start:end by start,
    then kind), n_live and n_example of the spans' values. By default the owner is ``source`` and its
    repositories are its languages."""
    owner = F.col("source") if owner is None else owner
    repo = F.col("lang") if repo is None else repo
    scanned = scan(docs, owner, repo)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    shown = judged_spans(scanned, max_owners, max_repos).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    by_row = shown.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", name.alias("name")))).alias("s"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
    )
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    by_row = by_row.select("row_id", text.alias("spans_text"), "n_live", "n_example")
    counted = ["doc_id", "n_assign", "n_access", "n_hex", "base"]
    some = scanned.where("size(spans) > 0").drop("spans").join(by_row, "row_id", "left").select(*counted, F.coalesce("spans_text", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    none = scanned.where("size(spans) = 0").select(*counted, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return none.unionByName(some)


def _redactor(live_column: str):
    def redact(batches):
        for b in batches:
            texts, sizes = [], []
            for text, live in zip(b.column("text").to_pylist(), b.column(live_column).to_pylist()):
                if text:
                    live = set(live or ())
                    out, at = [], 0
                    for s, kind, e, value in find_spans(text):
                        if e > at and (kind < 3 or hashlib.sha256(value.encode()).digest() in live):
                            out += [text[at : max(s, at)], f"<{KINDS[kind]}>" if s >= at else ""]
                            at = e
                    if at:
                        text = "".join(out) + text[at:]
                        sizes.append(len(text))
                    else:
                        sizes.append(None)
                else:
                    sizes.append(None)
                texts.append(text)
            cols = {n: b.column(n) for n in b.schema.names if n != live_column}
            cols["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in cols:
                new = pa.array(sizes, pa.int64()).cast(b.schema.field("n_chars").type)
                cols["n_chars"] = pc.coalesce(new, cols["n_chars"])
            yield pa.RecordBatch.from_pydict(cols)

    return redact


#: Documents with live tokens up to which their values (some 50 bytes each) are broadcast; beyond, both sides shuffle.
MAX_BROADCAST_ROWS = 200_000


def redact_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The documents with every base span, and every live-looking opaque token, replaced by its kind in angle brackets; n_chars, if
    there is one, follows. Every row is cut at the spans of its own text, whatever its doc_id, null and repeated ones
    too; texts without spans are unchanged, as are all other columns."""
    scanned = scan(docs, F.col("source"), F.col("lang"))
    held = keep(ownership(scanned).where(_live(max_owners, max_repos)).select("value"), "live")
    tokens = scanned.where("size(spans) > 0").select("text_key", F.inline("spans")).where("kind = 3").select("text_key", "value").distinct()
    key, live = unused(docs, "text_key"), unused(docs, "live_values")
    added = tokens.join(held, "value").groupBy("text_key").agg(F.collect_set("value").alias(live)).withColumnRenamed("text_key", key)
    added = keep(added, "secret-added")
    added = F.broadcast(added) if added.count() <= MAX_BROADCAST_ROWS else added
    return docs.withColumn(key, _text_key()).join(added, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], live).mapInArrow(_redactor(live), docs.schema)
