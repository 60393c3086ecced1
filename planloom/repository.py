"""A repository of plan logs, nodes and parameters of one or more servers, as partitioned Parquet tables.

``log``, ``nodes``, ``sums`` and ``params`` are partitioned by server; all but the log also by a 1000-way hash of planid,
one file for each hash and intake.  ``sums`` hold what is kept of each intake's nodes, under the intake's last number: an
intake that is run again replaces itself.  Parameters are made anew for the hashes that an intake touches, from sums
alone.  Servers are registered in ``servers.json``, without credentials.
"""

from __future__ import annotations

import json
import re

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.params import push as push_rows
from .functions.scalar import hash_dir
from .operators import regression
from .plans.schema import PLAN_LOG
from .sources import plan_log
from .streaming.ingest import nodes_of

_NAME = re.compile(r"\w+")
TABLES = ("log", "nodes", "sums", "params")


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    # --- servers

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Repository:
        repo = cls(spark, path)
        if repo._exists(""):
            raise FileExistsError(path)
        repo.fs.create_dir(repo.root, recursive=True)
        repo._save({})
        return repo

    def _exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}".rstrip("/")).type != pafs.FileType.NotFound

    def servers(self) -> dict[str, dict]:
        with self.fs.open_input_stream(f"{self.root}/servers.json") as f:
            return json.loads(f.read())

    def _save(self, servers: dict) -> None:
        with self.fs.open_output_stream(f"{self.root}/servers.json") as f:
            f.write(json.dumps(servers, indent=1, sort_keys=True).encode())

    def add(self, server: str, **facts) -> None:
        if not _NAME.fullmatch(server):
            raise ValueError(f"a server's name has letters, digits and underscores only: {server!r}")
        self._save(self.servers() | {server: {"seqid": 0, **facts}})

    def check(self) -> list[str]:
        """Names that break the rule."""
        return [s for s in self.servers() if not _NAME.fullmatch(s)]

    def show(self, verbose: bool = False) -> list[str]:
        return [f"{s} {json.dumps(f, sort_keys=True)}" if verbose else s for s, f in sorted(self.servers().items())]

    def _known(self, server: str) -> dict:
        servers = self.servers()
        if server not in servers:
            raise KeyError(f"no such server: {server}")
        return servers

    def rename(self, old: str, new: str) -> None:
        servers = self._known(old)
        if new in servers or not _NAME.fullmatch(new):
            raise ValueError(f"can't rename to {new!r}")
        for table in TABLES:
            if self._exists(f"{table}/server={old}"):
                self.fs.move(f"{self.root}/{table}/server={old}", f"{self.root}/{table}/server={new}")
        servers[new] = servers.pop(old)
        self._save(servers)

    def delete(self, server: str) -> None:
        servers = self._known(server)
        for table in TABLES:
            self._drop(f"{table}/server={server}")
        del servers[server]
        self._save(servers)

    def _drop(self, name: str) -> None:
        if self._exists(name):
            self.fs.delete_dir(f"{self.root}/{name}")

    # --- ingestion

    def get(self, server: str, log: DataFrame) -> int:
        """Take over what is new in a server's log, then nodes and parameters; the number of new rows."""
        servers = self._known(server)
        cursor, upto = servers[server]["seqid"], plan_log.max_seqid(log)
        new = plan_log.read_since(log, cursor, upto)
        if upto <= cursor:
            return 0
        target = f"{self.path}/log/server={server}/upto={upto:020d}"
        new.write.mode("overwrite").parquet(target)
        held = self.spark.read.schema(PLAN_LOG).parquet(target)
        self._take(server, held, f"server={server}/upto={upto:020d}")
        self._regress(server, f"sums/server={server}/upto={upto:020d}")
        servers[server]["seqid"] = upto
        self._save(servers)
        return held.count()

    def _take(self, server: str, log: DataFrame, place: str, under: str = "") -> None:
        """The nodes of log rows and what is kept of them."""
        nodes = nodes_of(log, server)
        self._partitioned(nodes, f"{under}nodes/{place}")
        # without any captured plan there is no file to take a schema from
        held = self.spark.read.schema(nodes.schema).parquet(f"{self.path}/{under}nodes/{place}").select(nodes.columns)
        self._partitioned(regression.learnt(held), f"{under}sums/{place}")

    def _partitioned(self, rows: DataFrame, place: str, mode: str = "static") -> None:
        dealt = rows.drop("dir").withColumn("dir", hash_dir(F.col("planid"))).repartition("dir")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("dir").parquet(f"{self.path}/{place}")

    def _regress(self, server: str, touched: str | None = None) -> None:
        """Parameters of the plans in the hashes that an intake touched (at most 1000 names), or of all."""
        names = [i.base_name.removeprefix("dir=") for i in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{touched}")) if i.base_name.startswith("dir=")] if touched else []
        if touched and not names:
            return
        kept = self._read("sums", server)
        kept = kept.where(F.col("dir").isin(names)) if touched else kept
        found = regression.parameters_of(regression.merge_sums(kept.drop("upto", "dir")))
        self._partitioned(found, f"params/server={server}", "dynamic" if touched else "static")

    def reset(self, server: str) -> None:
        """Forget nodes and parameters; the log is read from its beginning again."""
        servers = self._known(server)
        for table in TABLES:
            self._drop(f"{table}/server={server}")
        servers[server]["seqid"] = 0
        self._save(servers)

    def recalc(self, server: str) -> None:
        """Nodes and parameters anew from the stored log; the old ones go once the new ones are written."""
        self._known(server)
        place = f"server={server}/upto={self.servers()[server]['seqid']:020d}"
        self._drop("new")
        self._take(server, self.log(server), place, "new/")
        for table in ("nodes", "sums"):
            self._drop(f"{table}/server={server}")
            self.fs.create_dir(f"{self.root}/{table}", recursive=True)
            self.fs.move(f"{self.root}/new/{table}/server={server}", f"{self.root}/{table}/server={server}")
        self._drop("new")
        self._regress(server)

    # --- tables

    def _read(self, table: str, server: str) -> DataFrame:
        # hashes keep their leading zeros
        rows = self.spark.read.option("basePath", f"{self.path}/{table}/server={server}").parquet(f"{self.path}/{table}/server={server}")
        return rows.withColumn("dir", F.lpad(F.col("dir").cast("string"), 3, "0")) if "dir" in rows.columns else rows

    def log(self, server: str) -> DataFrame:
        return self._read("log", server).drop("upto")

    def nodes(self, server: str) -> DataFrame:
        return self._read("nodes", server).drop("upto", "dir")

    def parameters(self, server: str) -> DataFrame:
        return self._read("params", server).drop("dir")

    def push(self, server: str, target: str) -> DataFrame:
        """Write the parameters of each database's newest plans; what was written."""
        reg = push_rows(self.parameters(server), self.log(server))
        plan_log.write_parameters(reg, target)
        return reg
