"""Command line: ``python -m tidemark COMMAND [--config FILE]``, or spark-submit with this file."""

from __future__ import annotations

import argparse
import importlib
import json
import signal
import sys
import threading

from pyspark.sql import SparkSession

from tidemark import config as settings
from tidemark.plans import render, study
from tidemark.streaming import exchange, feed, gateway, live, progress


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--config", help="TOML file; defaults are used without it")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init-config", help="print the default settings")
    collect = commands.add_parser("collect", help="follow a folder of JSON files with frame, receive_ns and epoch")
    collect.add_argument("--frames", required=True)
    collect.add_argument("--checkpoint", required=True, help="folder shared by driver and executors")
    collect.add_argument("--files-per-batch", type=int, default=100)
    collect.add_argument("--once", action="store_true", help="take what is there and end")
    collect.add_argument("--alerts", action="store_true")
    collect.add_argument("--rest", metavar="URL", help="the exchange's pages of markets and tickers, with --socket")
    collect.add_argument("--socket", metavar="URL", help="also follow the exchange's WebSocket, for the markets of the greatest traded value")
    collect.add_argument("--server", metavar="URL", help="fetch frames from this frame server into the folder, see tidemark.sources.frames")
    collect.add_argument("--listen", metavar="HOST:PORT", default="127.0.0.1:0", help="where executors fetch the frames of --feed; on a cluster this host's own address")
    collect.add_argument("--feed", metavar="MODULE:CLASS", help="also run connections: an object with universe() and connect(markets), see tidemark.streaming.feed")
    commands.add_parser("analyze", help="find, select and validate rules")
    for name in ("report", "coverage", "paper"):
        commands.add_parser(name).add_argument("--csv", action="store_true")
    commands.add_parser("alert", help="replay the archive's alerts").add_argument("--json", action="store_true")
    return top


def _collect(spark: SparkSession, config: settings.Config, args) -> None:
    rules, audit = {}, {}
    if args.alerts:
        try:
            audit = study.ruleset(spark, config)
            rules = study.qualified(audit)
        except study.Blocked as why:
            print(f"alerts blocked: {why}; collection continues", file=sys.stderr)
    connections = worker = server = landing = None
    if args.feed or args.socket:
        if args.feed:
            module, _, name = args.feed.partition(":")
            source = getattr(importlib.import_module(module), name)()
        else:
            source = exchange.Exchange(spark, args.rest, args.socket, config.top_market_count)
        log = gateway.FrameLog()
        server = gateway.Gateway(log, *args.listen.rsplit(":", 1)[:1], int(args.listen.rsplit(":", 1)[1]))
        connections = feed.Feed(spark, config, log, source.universe, source.connect)
        worker = threading.Thread(target=connections.watched, args=(1 if args.once else None,))
        worker.start()
        if args.once:
            worker.join()
            if connections.failed:
                raise connections.failed
        landing = live.land(spark, server.url, args.frames, args.checkpoint, args.once)
        if args.once:
            landing.awaitTermination()
    elif args.server:
        landing = live.land(spark, args.server, args.frames, args.checkpoint, args.once)
        if args.once:
            landing.awaitTermination()
    frames = spark.readStream.schema(live.FRAMES).option("maxFilesPerTrigger", args.files_per_batch).json(args.frames)
    told = progress.Progress()
    spark.streams.addListener(told)
    running = live.collect(frames, config.data_root, args.checkpoint, config, list(rules), args.once)
    if args.once:
        for q in running:
            q.awaitTermination()
    if rules:
        running.append(live.send_alerts(spark, config.data_root, args.checkpoint, config, rules, audit, args.once))
    _until_stopped([landing, *running] if landing else running, connections, worker)
    if server:
        server.close()
    spark.streams.removeListener(told)
    print(told.line(), file=sys.stderr)


def _until_stopped(running: list, connections: feed.Feed | None, worker: threading.Thread | None) -> None:
    """Wait for the queries' end, for SIGINT or SIGTERM, or for a feed that fails; then what the feed holds is written,
    and what has arrived goes through the queries before they stop. A failed feed is an error in the end."""
    asked = threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: asked.set())
    while any(q.isActive for q in running) and not asked.wait(0.2) and not (connections and connections.failed):
        pass
    if connections:
        connections.stop.set()
        worker.join()
    for q in running:
        if asked.is_set() or connections and connections.failed:
            live.finish(q)
        q.awaitTermination()
    if connections and connections.failed:
        raise connections.failed


def run(args, config: settings.Config, spark: SparkSession) -> int:
    if args.command == "collect":
        _collect(spark, config, args)
    elif args.command == "analyze":
        audit = study.analyze(spark, config)
        print(f"generated {audit['signal_count']} candidate signals; selected {len(audit['results'])} rules for untouched validation")
    elif args.command == "report":
        audit = study.ruleset(spark, config)
        print(render.evaluation_csv(audit) if args.csv else render.evaluation_markdown(audit), end="")
    elif args.command == "coverage":
        shown, summary = study.collected(spark, config, args.csv)
        print(shown, end="")
        print(summary, end="", file=sys.stderr if args.csv else sys.stdout)
    elif args.command == "paper":
        done = study.paper_study(spark, config)
        if done is None:
            print("paper blocked: no validation-qualified rules")
        else:
            print(render.paper_csv(done) if args.csv else render.paper_markdown(done), end="")
    elif args.command == "alert":
        try:
            for event in study.alerts(spark, config):
                print(json.dumps(event, default=str) if args.json else render.alert(event["signal"], event["validation"], event["window"]), end="\n" if args.json else "")
        except study.Blocked as why:
            print(f"alerts blocked: {why}", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init-config":
        print(settings.template(), end="")
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(args, settings.load(args.config).check(), spark)


if __name__ == "__main__":
    sys.exit(main())
