"""Incremental import: statement files that arrive in a folder are committed batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook import schemas
from tallybook.operators.commit import commit_import
from tallybook.operators.dedup import assign_period, ledger_keys
from tallybook.operators.ingest import (
    detect_period, parse_cells, split_errors, suggest_category,
)
from tallybook.operators.keywords import keyword_rules
from tallybook.session import cut_lineage, scratch
from tallybook.sources.csv_files import literal_path, scan_csv
from tallybook.sources.ledger_store import TableStore, new_batch, publish
from tallybook.sources.ofx_files import ofx_upload

C, L = F.col, F.lit

OFX_NAMES = (".ofx", ".qfx")
FILE_LISTING = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class Books:
    """The stored tables an import reads and extends, all in one folder.

    `keys` holds the ledger's duplicate keys and `rejects` what an import could not take.
    """

    ledger: TableStore
    accounts: TableStore
    categories: TableStore
    batches: TableStore
    keys: TableStore
    rejects: TableStore

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Books:
        return cls(TableStore(spark, f"{folder}/ledger", schemas.LEDGER, "transaction_date"),
                   TableStore(spark, f"{folder}/accounts", schemas.ACCOUNTS),
                   TableStore(spark, f"{folder}/categories", schemas.CATEGORIES),
                   TableStore(spark, f"{folder}/batches", schemas.IMPORT_BATCHES),
                   TableStore(spark, f"{folder}/keys", schemas.LEDGER_KEYS, "day"),
                   TableStore(spark, f"{folder}/rejects", schemas.REJECTS))

    def tables(self) -> list[TableStore]:
        return [getattr(self, f.name) for f in fields(self)]

    def open_with(self, ledger: DataFrame, accounts: DataFrame, categories: DataFrame) -> None:
        """First rows of the books."""
        self.accounts.append(accounts)
        self.categories.append(categories)
        self.keys.append(ledger_keys(ledger))
        self.ledger.append(ledger)

    def change(self, ids: DataFrame, update: Callable[[DataFrame], DataFrame]) -> None:
        """Ledger rows named by ids(id) replaced by update(rows), and their keys with them.

        Only the months those rows leave or enter are rewritten. `update` must give the same again
        when the change is repeated after it broke off.
        """
        ids = cut_lineage(ids.select("id").distinct())  # it may come from the ledger itself
        self.ledger.change(ids, update)
        now = self.ledger.read().join(ids, "id", "left_semi")
        self.keys.change(ids, lambda _: ledger_keys(now))


def import_files(spark: SparkSession, paths: list[str], books: Books, token: str,
                 user: Column | None = None, default_currency: str = "CAD") -> None:
    """Scan, suggest, de-duplicate and commit files as one upload per user.

    Paths that end in .ofx or .qfx, in any case, are OFX files; all others are CSV exports.
    All tables are written under a new batch name, which is published last: an import that broke
    off anywhere left nothing that readers see, and repeating it does it whole. A token that is
    published adds nothing more. Files without a known header and rows that could not be read are
    kept in `rejects`. Files sent again later are recognised row by row by the duplicate rules.
    """
    if not books.ledger.published().where(C("token") == token).isEmpty():
        return
    batch = new_batch()
    ofx = [p for p in paths if p.lower().endswith(OFX_NAMES)]
    exports = [p for p in paths if p not in ofx]
    rejects, parsed = spark.createDataFrame([], schemas.REJECTS), None
    if exports:
        with scratch(spark) as lasting:  # the cells as landed are not needed beside parsed rows
            scan = scan_csv(spark, exports, user)
            if "date_raw" in scan.rows.columns:
                parsed = lasting(parse_cells(scan.rows, default_currency))
        rejects = rejects.unionByName(scan.rejected.select(
            L(token).alias("token"), L(None).cast("string").alias("user_id"), "source_file",
            L(None).cast("long").alias("row_idx"), "message"))
    if ofx:
        first = 0 if parsed is None else parsed.agg(
            F.coalesce(F.max("row_idx") + 1, L(0))).first()[0]
        more = cut_lineage(ofx_upload(spark, ofx, user, default_currency, first))
        parsed = more if parsed is None else parsed.unionByName(more)
    if parsed is not None:
        good, errors = split_errors(parsed)
        rejects = rejects.unionByName(errors.withColumn("token", L(token)))
        _stage_rows(good, books, token, batch)
    books.rejects.stage(rejects, batch)
    publish(token, batch, books.tables())


def _stage_rows(good: DataFrame, books: Books, token: str, batch: str) -> None:
    """What an upload adds to the books, written under its batch name."""
    categories = books.categories.read()
    rows = cut_lineage(suggest_category(good, keyword_rules(categories)))
    periods = cut_lineage(detect_period(rows))
    upload = assign_period(rows, periods, periods.limit(0)).withColumns({
        "exclude": L(False), "category_name": L(None).cast("string"),
        "notes": L(None).cast("string")})
    result = commit_import(upload, books.ledger.read(), books.accounts.read(), categories,
                           token=token, keys=books.keys.read())
    new_rows = cut_lineage(result.new_rows)
    books.accounts.stage(result.new_accounts, batch)
    books.categories.stage(result.new_categories, batch)
    books.batches.stage(result.batches, batch)
    books.keys.stage(ledger_keys(new_rows), batch)
    books.ledger.stage(new_rows, batch)


def stream_import(spark: SparkSession, in_dir: str, books: Books, checkpoint: str,
                  name: str = "statements", files_per_batch: int = 100,
                  user: Column | None = None,
                  default_currency: str = "CAD") -> StreamingQuery:
    """Import the files of a folder and those that arrive later, each exactly once.

    Only file names travel through the stream; every micro-batch commits its files against the
    ledger as stored then. Stops when the folder is drained (availableNow).
    """
    files = (spark.readStream.format("binaryFile").schema(FILE_LISTING)
             .option("maxFilesPerTrigger", files_per_batch)
             .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,CSV,ofx,OFX,qfx,QFX}")
             .load(in_dir).select("path"))

    def commit(batch: DataFrame, batch_id: int) -> None:
        # at most files_per_batch names
        paths = [literal_path(r["path"]) for r in batch.collect()]
        if paths:
            import_files(batch.sparkSession, paths, books, f"{name}-{batch_id}", user,
                         default_currency)

    return (files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
