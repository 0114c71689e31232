"""Filings, artifacts, forecasts, jobs and reports that stand around the market plans."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions.scalars import normalize_symbol
from tallyrill.operators.engine import Engine, Transaction
from tallyrill.sources.store import StoreError

#: The forms that count, the patterns of identifiers, and the archive's address.
FORMS = ("10-K", "10-Q", "8-K", "10-K/A", "10-Q/A", "8-K/A")
CIK, ACCESSION, DOCUMENT = r"^(?!0{10}$)[0-9]{10}$", r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$", r"^[a-zA-Z0-9][a-zA-Z0-9_.-]{0,159}\.html?$"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"
SUBMISSIONS = "cik string, tickers array<string>, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, acceptanceDateTime: array<string>, primaryDocument: array<string>>>"
CHUNK, MAX_ARTIFACT = 1800, 8 << 20


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(ARCHIVE), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def filing_fault(cik: Column, accession: Column, document: Column, published: Column) -> Column:
    """What is wrong with a filing's identifiers, or null."""
    bad = lambda c, pattern: ~F.coalesce(c.rlike(pattern), F.lit(False))
    return F.when(bad(cik, CIK), "cik").when(bad(accession, ACCESSION), "accession").when(bad(document, DOCUMENT), "document").when(F.coalesce(published, F.lit(0)) <= 0, "time")


def filings(payloads: DataFrame, top: int = 20) -> DataFrame:
    """The newest filings of each (symbol, cik, payload): parallel arrays become rows.

    ``fault`` names what makes a payload or a row unusable: ``payload``, ``cik``, ``symbol``, ``arrays``, or an identifier; such rows come first and only good rows count for ``top``.
    """
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    read = payloads.select(normalize_symbol(F.col("symbol")).alias("symbol"), "cik", F.from_json("payload", SUBMISSIONS).alias("p"))
    r = F.col("p.filings.recent")
    arrays = [r[c] for c in ("accessionNumber", "form", "acceptanceDateTime", "primaryDocument")]
    even = F.size(arrays[0]) >= 0
    for a in arrays[1:]:
        even = even & (F.size(a) == F.size(arrays[0]))
    fault = F.when(r.isNull(), "payload").when(bare(F.col("cik")) != bare(F.col("p.cik")), "cik").when(~F.exists("p.tickers", lambda t: F.upper(t) == F.col("symbol")), "symbol").when(~F.coalesce(even, F.lit(False)), "arrays")
    read = read.withColumn("fault", fault)
    broken = read.filter("fault is not null").select("symbol", "cik", *(F.lit(None).cast("string").alias(c) for c in ("accession", "form", "document")), F.lit(None).cast("bigint").alias("published_at"), F.lit(None).cast("string").alias("url"), "fault")
    zipped = F.arrays_zip(*(a.alias(n) for a, n in zip(arrays, ("accession", "form", "accepted", "document"), strict=True)))
    rows = read.filter("fault is null").select("symbol", "cik", F.explode(zipped).alias("z")).select("symbol", "cik", "z.*").filter(F.col("form").isin(*FORMS))
    rows = rows.withColumn("published_at", F.unix_timestamp(F.try_to_timestamp("accepted")))
    rows = rows.select("symbol", "cik", "accession", "form", "document", "published_at", filing_url(F.col("cik"), F.col("accession"), F.col("document")).alias("url"), filing_fault(F.col("cik"), F.col("accession"), F.col("document"), F.col("published_at")).alias("fault"))
    place = F.row_number().over(Window.partitionBy("symbol", "cik").orderBy(F.desc("published_at"), F.desc("accession")))
    good = rows.filter("fault is null").withColumn("place", place).filter(F.col("place") <= top).drop("place")
    return broken.unionByName(rows.filter("fault is not null")).unionByName(good)


def filings_at(stored: DataFrame, as_of: int, top: int = 3) -> DataFrame:
    """Each symbol's newest filings known at a time: published within a year before, retrieved by then, one row (the newest) for an accession."""
    known = stored.filter((F.col("published_at") <= as_of) & (F.col("published_at") >= max(1, as_of - 365 * 86_400)) & (F.col("retrieved_at") <= as_of))
    best = known.groupBy("symbol", "accession").agg(F.max(F.struct("published_at", "retrieved_at", *(c for c in stored.columns if c not in ("symbol", "accession", "published_at", "retrieved_at")))).alias("b"))
    rows = best.select("symbol", "accession", "b.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("published_at"), F.desc("accession")))).filter(F.col("place") <= top).drop("place")


def artifact_rows(payloads: DataFrame) -> DataFrame:
    """(run_id, kind, chunk, payload, digest, chunks) of each binary (run_id, kind, payload); chunks of CHUNK bytes, 1 byte to 8 MiB in all."""
    size = F.length("payload")
    checked = F.when((size > 0) & (size <= MAX_ARTIFACT), F.col("payload")).otherwise(F.raise_error(F.lit("an artifact holds 1 byte to 8 MiB")))
    whole = payloads.select("run_id", "kind", checked.alias("payload")).withColumn("chunks", F.ceil(F.length("payload") / CHUNK).cast("bigint"))
    cut = whole.select("run_id", "kind", F.sha2("payload", 256).alias("digest"), "chunks", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    return cut.select("run_id", "kind", "chunk", F.substring("payload", (F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("payload"), "digest", "chunks")


def artifacts(rows: DataFrame) -> DataFrame:
    """(run_id, kind, payload, digest, chunks, fault): chunks put together; ``fault`` is null, ``sequence``, ``size`` or ``checksum``."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "payload")))
    each = rows.groupBy("run_id", "kind").agg(parts.alias("parts"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.min("chunks").alias("chunks"), F.max("chunks").alias("most"))
    # binary concatenation by hex, since array_join takes strings
    each = each.withColumn("payload", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), "")))
    order = F.transform("parts", lambda p: p["chunk"]) == F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("chunks") - 1, F.lit(0).cast("bigint")))
    fault = F.when((F.col("digest") != F.col("other")) | (F.col("chunks") != F.col("most")) | ~order, "sequence").when(F.length("payload") > MAX_ARTIFACT, "size").when(F.sha2("payload", 256) != F.col("digest"), "checksum")
    return each.select("run_id", "kind", F.when(fault.isNull(), F.col("payload")).alias("payload"), "digest", "chunks", fault.alias("fault"))


def put_once(tx: Transaction, table: str, rows: DataFrame, compared: list[str]) -> int:
    """Insert rows that are new; a retry with the same ``compared`` values changes nothing, other values are an error."""
    spec = tx.spec(table)
    old = tx.frame(table).select(*spec.key, F.struct(*compared).alias("old"))
    met = tx._kept(rows.join(old, spec.key, "left"))
    if met.filter(F.col("old").isNotNull() & (F.struct(*compared) != F.col("old"))).limit(1).count():
        raise StoreError(f"rows of {table} are immutable")
    return tx.put(table, met.filter("old is null").drop("old"), "insert").rows_affected


def at_most(df: DataFrame, limit: int) -> DataFrame:
    """The rows, or an error where there are more than ``limit``; at most limit + 1 are counted."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; split the range")
    return df


def latest_version(migrations: DataFrame) -> int:
    """The newest schema version, 0 without any."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v


def canonical_object(text: str, limit: int = 1536) -> str:
    """A JSON object with sorted keys; empty text is the empty object."""
    value = json.loads(text) if text.strip() else {}
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if len(out.encode()) > limit:
        raise ValueError(f"a JSON object of more than {limit} bytes")
    return out


def decode_answer(text: bytes) -> dict:
    """A model's answer: one object with exactly outlook, evidence_ids and abstain_reason, none twice or null, nothing behind it."""
    keys = {"outlook": str, "evidence_ids": list, "abstain_reason": str}

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    try:
        value = json.loads(text, object_pairs_hook=unique) if 0 < len(text) <= 8192 else None
    except (ValueError, RecursionError) as error:
        raise ValueError("invalid answer") from error
    good = isinstance(value, dict) and value.keys() == keys.keys() and all(type(value[k]) is t for k, t in keys.items())
    if not good or not all(type(e) is str for e in value["evidence_ids"]):
        raise ValueError("invalid answer")
    return value


def markdown(text: str) -> str:
    """Text for a cell of a Markdown table."""
    return "".join("\\" + c if c in "\\|`*_[]<>#" else " " if c in "\r\n" else c for c in text)


def model_card(rows: list[dict]) -> str:
    """A Markdown table of a report's few rows."""
    names = list(rows[0]) if rows else []
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else markdown(str(v))
    lines = ["| " + " | ".join(map(markdown, names)) + " |", "|" + " --- |" * len(names)] if names else ["No results."]
    return "\n".join([*lines, *("| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def scorecard(cases: DataFrame) -> DataFrame:
    """Accuracy, citation precision and abstention recall of (expected, outlook, cited array, supported array)."""
    good = F.size(F.array_intersect("cited", "supported"))
    share = lambda a, b: F.when(b > 0, a / b)
    n, right = F.count(F.lit(1)), F.count_if(F.col("expected") == F.col("outlook"))
    abstained, both = F.count_if(F.col("expected") == "abstain"), F.count_if((F.col("expected") == "abstain") & (F.col("outlook") == "abstain"))
    return cases.agg(n.alias("cases"), right.alias("correct"), share(right, n).alias("accuracy"), share(F.sum(good), F.sum(F.size("cited"))).alias("citation_precision"), share(both, abstained).alias("abstention_recall"))


def overview(bars: DataFrame, features: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per symbol its last bar, the features at that bar, and the newest forecast made by then."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    known = forecasts.join(last.select("symbol", F.col("ts").alias("now")), "symbol").filter("as_of_ts <= now")
    newest = known.groupBy("symbol").agg(F.max_by("predicted", "as_of_ts").alias("predicted"), F.max("as_of_ts").alias("as_of_ts"))
    return last.join(features, ["symbol", "ts"], "left").join(newest, "symbol", "left")


class Jobs:
    """A durable queue in a table: queued, running, then completed, failed or cancelled."""

    TABLE = "create table jobs (job_id string, kind string, status string, request string, result string, digest string, created int, started int, finished int, cancel int, primary key (job_id), index (status, created, job_id))"

    def __init__(self, engine: Engine, kinds: tuple[str, ...]):
        self.engine, self.kinds = engine, kinds
        if "jobs" not in {t.name for t in engine.tables()}:
            engine.execute(self.TABLE)

    def _row(self, tx: Transaction, job: str) -> dict | None:
        found = tx.frame("jobs").filter(F.col("job_id") == job).first()
        return found.asDict() if found else None

    def submit(self, kind: str, request: str, key: str = "") -> tuple[str, bool]:
        """(job id, whether it is new).  The same key and request give the same job, another request under the key is an error."""
        if kind not in self.kinds or key and not 8 <= len(key) <= 128:
            raise ValueError("unknown kind or unfit key")
        text = canonical_object(request)
        digest = hashlib.sha256(f"{kind}\0{text}".encode()).hexdigest()
        job = "job_" + (hashlib.sha256(key.encode()).hexdigest()[:32] if key else uuid.uuid4().hex)

        def work(tx):
            old = self._row(tx, job)
            if old and old["digest"] != digest:
                raise StoreError("the key belongs to another request")
            if not old:
                tx.apply_batch([("insert", "jobs", {"job_id": job, "kind": kind, "status": "queued", "request": text, "result": "", "digest": digest, "created": int(time.time()), "started": 0, "finished": 0, "cancel": 0})])
            return job, not old

        return self.engine.run(work)

    def claim(self) -> dict | None:
        """The oldest queued job, now running; None without any."""

        def work(tx):
            found = tx.execute("select * from jobs index by status = 'queued' limit 1").first()
            if found:
                tx.apply_batch([("update", "jobs", {**found.asDict(), "status": "running", "started": int(time.time())})])
            return found and found.asDict()

        return self.engine.run(work)

    def _end(self, job: str, status: str, result: str, only: tuple[str, ...]) -> bool:
        def work(tx):
            old = self._row(tx, job)
            if not old or old["status"] not in only:
                return False
            tx.apply_batch([("update", "jobs", {**old, "status": status, "result": result, "finished": int(time.time())})])
            return True

        return self.engine.run(work)

    def finish(self, job: str, result: str = "", failed: bool = False) -> bool:
        return self._end(job, "failed" if failed else "completed", result, ("running",))

    def cancel(self, job: str) -> bool:
        """A queued job ends at once; a running one is asked to."""

        def work(tx):
            old = self._row(tx, job)
            if old and old["status"] == "running":
                tx.apply_batch([("update", "jobs", {**old, "cancel": 1})])
            return bool(old) and old["status"] == "running"

        return self._end(job, "cancelled", "", ("queued",)) or self.engine.run(work)

    def recover(self) -> int:
        """After a restart, jobs that were running count as failed."""
        return self.engine.execute("update jobs set status = 'failed', result = 'restart' index by status = 'running'").rows_affected
