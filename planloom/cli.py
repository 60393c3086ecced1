"""Command line: ``python -m planloom.cli REPOSITORY COMMAND ...``.

``analyze`` writes its reports as JSON lines under a folder, or shows their first rows without one.  ``progress`` watches the running queries of another
application through its monitoring API and asks for the number of the one to look at; ``sample`` records their
snapshots in a folder, and ``replay`` gives the progress of what was recorded.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from .operators.analyze import histogram_skew, join_training, misestimates, query_texts
from .operators.progress import bar
from .repository import Repository
from .session import local_session
from .sources import snapshot


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="planloom")
    p.add_argument("repository")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("create")
    sub.add_parser("check")
    show = sub.add_parser("show")
    show.add_argument("--verbose", action="store_true")
    for name, *extra in (("add",), ("get", "log"), ("push", "target"), ("rename", "new"), ("delete",), ("reset",), ("recalc",), ("analyze", "out"), ("replay", "samples")):
        c = sub.add_parser(name)
        c.add_argument("server")
        for e in extra:
            c.add_argument(e, nargs="?" if name == "analyze" else None)
        if name == "delete":
            c.add_argument("--yes", action="store_true")
    for name in ("progress", "sample"):
        c = sub.add_parser(name)
        c.add_argument("url", help="the monitoring API, such as http://localhost:4040/api/v1")
        c.add_argument("--every", type=float, default=1.0)
        c.add_argument("--rounds", type=int, default=60)
        if name == "sample":
            c.add_argument("samples")
    return p


def reports(nodes: DataFrame, log: DataFrame, out: str | None) -> dict[str, DataFrame]:
    """What the collected plans say, written as JSON lines in a folder each under ``out``, if given."""
    found = {"extended_statistics": misestimates(nodes), "histograms": histogram_skew(nodes).where("skewed"), "join_training": join_training(nodes), "queries": query_texts(log)}
    for name, rows in found.items() if out else ():
        rows.write.mode("overwrite").json(f"{out}/{name}")
    return found


def ask_progress(url: str, ask=input, say=print, width: int = 50) -> None:
    """The running queries' progress, again and again: a number picks one query, ``v`` shows or hides texts, ``h`` says
    so, nothing asks for the same again, ``quit`` ends."""
    pid, verbose = None, False
    while (word := ask(f"number of a query (now: {'all' if pid is None else pid}), v, h or quit: ").strip().lower()) != "quit":
        if word in ("h", "help"):
            say(ask_progress.__doc__)
        elif word in ("v", "verbose"):
            verbose = not verbose
        elif word and not word.isdigit():
            say(f"not a number: {word}")
        else:
            pid = int(word) if word else pid
            found = snapshot.measured(snapshot.rest_rows(url, pid=pid))
            say("\n".join(f"{n} {bar(share, width)}" + (f"\n{text}" if verbose else "") for n, text, share in found) or "nothing runs")


def main(argv: list[str] | None = None, spark=None, ask=input, say=print) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session("planloom")
    if a.command == "create":
        Repository.create(spark, a.repository)
        return 0
    if a.command == "progress":
        ask_progress(a.url, ask, say)
        return 0
    if a.command == "sample":
        held = snapshot.Sampler(spark, a.every, a.samples, take=lambda: snapshot.rest_rows(a.url))
        seen = sum(len(polled) for polled in snapshot.watch(lambda: range(held.poll()), a.every, a.rounds, list))
        say(f"{seen} snapshots")
        return 0
    repo = Repository(spark, a.repository)
    if a.command == "show":
        say("\n".join(repo.show(a.verbose)))
    elif a.command == "check":
        bad = repo.check()
        say("\n".join(bad) or "ok")
        return int(bool(bad))
    elif a.command == "add":
        repo.add(a.server)
    elif a.command == "get":
        say(f"{repo.get(a.server, spark.read.parquet(a.log))} new rows")
    elif a.command == "push":
        repo.push(a.server, a.target)
    elif a.command == "rename":
        repo.rename(a.server, a.new)
    elif a.command == "delete":
        if a.yes or ask(f"Delete {a.server}? (yes/no) ") == "yes":
            repo.delete(a.server)
    elif a.command == "reset":
        repo.reset(a.server)
    elif a.command == "recalc":
        repo.recalc(a.server)
    elif a.command == "analyze":
        for name, rows in reports(repo.nodes(a.server), repo.log(a.server), a.out).items():
            if a.out:
                say(f"{name}: {rows.count()}")
            else:
                rows.show(truncate=False)
    elif a.command == "replay":
        for r in snapshot.replay(spark, a.samples, parameters=repo.parameters(a.server)).orderBy("sample", "queryid").toLocalIterator():
            say(f"{r.sample} {r.queryid} {r.mode} {bar(r.progress)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
