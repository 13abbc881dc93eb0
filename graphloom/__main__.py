"""python -m graphloom index | search | callers | explore | tools ..."""

from __future__ import annotations

import argparse
import sys

from graphloom import query as Q
from graphloom.config import Config
from graphloom.session import build


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--root", help="folder of the tables")
    p.add_argument("--repo", help="repository name")
    p.add_argument("--output", choices=("table", "markdown", "json"))
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("index")
    i.add_argument("path")
    i.add_argument("--clean", action="store_true")
    i.add_argument("--watch", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("-k", type=int, default=5)
    for name in ("callers", "explore"):
        q = sub.add_parser(name)
        q.add_argument("text")
        q.add_argument("--page", type=int, default=1)
        q.add_argument("--size", type=int, default=Q.PAGE)
    t = sub.add_parser("tools", help="answers tool calls, one JSON message a line, from standard input")
    t.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    c = Config.load(root=a.root, repo_name=a.repo, output=a.output, repo_path=getattr(a, "path", None))
    if a.what == "tools" and a.dry_run:
        from graphloom import tools

        return tools.serve(None, sys.stdin, sys.stdout)
    spark = build()
    if a.what == "tools":
        from graphloom import tools

        return tools.serve(Q.CodeIndex.open(spark, c.root), sys.stdin, sys.stdout)
    if a.what == "index":
        from graphloom.streaming.watch import Indexer

        x = Indexer(spark, c.root, c.repo_path, c.repo_name, c.dependencies)
        print(x.run(a.clean))
        if a.watch:
            x.watch(f"{c.root}/_watch").awaitTermination()
        return 0
    index = Q.CodeIndex.open(spark, c.root)
    if a.what == "search":
        got = Q.rows(index.search(a.text, a.k, a.repo))
        show = {"json": Q.as_json, "markdown": Q.search_markdown, "table": Q.search_table}[c.output]
        print(show(got))
    else:
        got = Q.rows(getattr(index, a.what)(a.text, a.repo), a.page, a.size)
        by = {"callers": (Q.callers_markdown, Q.callers_table), "explore": (Q.explore_markdown, Q.explore_table)}[a.what]
        print(Q.as_json(got) if c.output == "json" else by[c.output == "table"](a.text, got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
