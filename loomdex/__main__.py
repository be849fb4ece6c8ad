"""Commands: ``python -m loomdex CONFIG search QUERY | refresh ROOT | status | project ID | scope IDS | on | off | watch``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .sources import config as configs
from .streaming.indexer import poll


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """The answer to a command, which is printed as well."""
    parser = argparse.ArgumentParser(prog="loomdex")
    parser.add_argument("config")
    commands = parser.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--root")
    find.add_argument("--limit", type=int)
    find.add_argument("--project", default="shared")
    find.add_argument("--scope", default="current")
    for name, extra in (("refresh", "root"), ("project", "id"), ("scope", "ids")):
        commands.add_parser(name).add_argument(extra)
    for name in ("status", "on", "off"):
        commands.add_parser(name)
    watch = commands.add_parser("watch")
    watch.add_argument("--seconds", type=float, default=60.0)
    watch.add_argument("--rounds", type=int, default=0, help="0: without end")
    given = parser.parse_args(args)
    config = configs.load(given.config)
    if given.command in ("on", "off"):
        config.enabled = given.command == "on"
        configs.save(config, given.config)
        out = given.command
    elif given.command == "project":
        out = configs.project_argument(config, given.id)
    elif given.command == "scope":
        out = " ".join(configs.scope_argument(config, given.ids))
    else:
        engine = Engine(spark or SparkSession.builder.getOrCreate(), config)
        if given.command == "search":
            ids = []
            if config.isolation:
                ids = configs.search_ids(config, configs.project_argument(config, given.project), configs.scope_argument(config, given.scope))
            out = engine.search(given.query, given.root, given.limit, ids).text()
        elif given.command == "refresh":
            out = json.dumps(engine.refresh(given.root))
        elif given.command == "status":
            out = "\n".join(json.dumps(row, default=str) for row in engine.status())
        else:
            seen: list[str] = []

            def roots() -> list[str]:
                engine.config = configs.load(given.config)
                return [r.name for r in engine.config.roots if r.exists]

            def stop() -> bool:
                return 0 < given.rounds * sum(r.exists for r in engine.config.roots) <= len(seen)

            poll(engine.refresh, roots, given.seconds, stop, lambda name, counts: seen.append(f"{name}: {json.dumps(counts)}"))
            out = "\n".join(seen)
    print(out)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
