"""Named relations, each a Spark frame and the SQL that DuckDB runs for it, and queries over them.

A query's text names relations in braces and marks what the dialects say differently (`functions/dialect.py`). Spark runs it over their frames, DuckDB with their SQL as common table
expressions; what relations hold is built and tested apart from the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barlab.functions.dialect import duck_text, spark_text
from barlab.plans.registry import QUERIES, SQL
from barlab.sources.bars import PANEL_SQL, bars, bars_sql, panel, table
from barlab.sources.shared import written_at


#: (application, folder, relation) -> (state of the folder's files and of the relation's text, frame, where it was written).
_SNAPSHOTS: dict[tuple, tuple[tuple, DataFrame, str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Deletes this application's snapshots, so that the next query works everything out, and drops what is known of other applications."""
    for key, (_, _, path) in list(_SNAPSHOTS.items()):
        if key[0] == spark.sparkContext.applicationId:
            _delete(spark, path)
        del _SNAPSHOTS[key]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def files_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every file of the tables in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.globStatus(path) or []:
        for x in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))


class Tables:
    """The relations of one query, each built once.

    Relations that are written are snapshots: another query of the same application reads them again as long as the
    folder's files are the same in name, size and time, the relation's text is, and the snapshot is still there. A
    snapshot that is replaced is deleted.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}
        self._files: tuple | None = None

    def get(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._snapshot(name) if RELATIONS[name].write else RELATIONS[name].frame(self)
        return self._built[name]

    def _snapshot(self, name: str) -> DataFrame:
        if self._files is None:
            self._files = files_of(self.spark, self.sf_dir)
        own = self.spark.sparkContext.applicationId
        for other in [k for k in _SNAPSHOTS if k[0] != own]:
            del _SNAPSHOTS[other]
        key, state = (own, self.sf_dir, name), (self._files, RELATIONS[name].sql)
        held = _SNAPSHOTS.get(key)
        if held is None or held[0] != state or not _exists(self.spark, held[2]):
            if held is not None:
                _delete(self.spark, held[2])
            _SNAPSHOTS[key] = (state, *written_at(RELATIONS[name].frame(self), name))
        return _SNAPSHOTS[key][1]

    def run(self, text: str) -> DataFrame:
        return self.spark.sql(spark_text(text), **{n: self.get(n) for n in _named(text)})


@dataclass(frozen=True)
class Relation:
    frame: Callable[[Tables], DataFrame]
    sql: str
    needs: tuple[str, ...] = ()
    #: Whether Spark writes it to the shared folder, as several parts of a query read it.
    write: bool = False


RELATIONS: dict[str, Relation] = {}


def relation(name: str, frame: Callable[[Tables], DataFrame], sql: str, *needs: str, write: bool = False) -> None:
    if name in RELATIONS:
        raise ValueError(f"two relations are called {name}")
    RELATIONS[name] = Relation(frame, sql, needs, write)


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_ordered(list(RELATIONS[n].needs)), n]:
            if m not in out:
                out.append(m)
    return out


def _named(text: str) -> list[str]:
    return [n for n in RELATIONS if "{" + n + "}" in text]


def with_clause(names: list[str]) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({RELATIONS[n].sql})" for n in _ordered(names))


def _plain(text: str) -> str:
    return duck_text(text.format(**{n: n for n in _named(text)}))


def query(name: str, text: str) -> None:
    """A query whose text both dialects understand."""
    QUERIES[name] = lambda s, d: Tables(s, d).run(text)
    SQL[name] = f"{with_clause(_named(text))} {_plain(text)}"


def computed(name: str, frame: Callable[[Tables], DataFrame], sql: str, *needs: str) -> None:
    """A query that Spark and DuckDB work out in ways of their own."""
    QUERIES[name] = lambda s, d: frame(Tables(s, d))
    SQL[name] = f"{with_clause(list(needs))} {sql}"


def derived(name: str, text: str, write: bool = False) -> None:
    """A relation that is a query over others."""
    relation(name, lambda t: t.run(text), _plain(text), *_named(text), write=write)


for _t in ("events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region", "embeddings", "labels", "documents", "pages", "conversations", "benchmark"):
    relation(f"t_{_t}", lambda t, n=_t: table(t.spark, t.sf_dir, n), f"SELECT * FROM {_t}")
relation("bars", lambda t: bars(t.spark, t.sf_dir), bars_sql(), write=True)
relation("bars0", lambda t: bars(t.spark, t.sf_dir), bars_sql())
relation("panel", lambda t: panel(t.spark, t.sf_dir), PANEL_SQL, write=True)
relation("numbers", lambda t: t.spark.range(1000).toDF("i"), "SELECT unnest(range(1000)) AS i")
