"""Command line: python -m tidemark ROOT put KEY VAL | get KEY | del KEY | delrange START END | scan [START] [END] [--reverse] [--limit N] | compact | stats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import scan
from .schema import Batch
from .sources.store import Store


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command", choices=["put", "get", "del", "delrange", "scan", "compact", "stats"])
    parser.add_argument("operands", nargs="*")
    parser.add_argument("--reverse", action="store_true")
    parser.add_argument("--limit", type=int, default=None, help="rows of a scan; all by default")
    parser.add_argument("--ttl", type=int, default=0)
    parser.add_argument("--now", type=int, default=0)
    a = parser.parse_args(args)
    store = Store(SparkSession.builder.getOrCreate(), a.root)
    x = [o.encode() for o in a.operands]
    if a.command == "put":
        print(store.write(Batch().put_ttl(x[0], x[1], a.ttl)))
    elif a.command == "del":
        print(store.write(Batch().delete(x[0])))
    elif a.command == "delrange":
        print(store.write(Batch().delete_range(x[0], x[1])))
    elif a.command == "get":
        got = store.get(x[0], now=a.now)
        if got is None:
            return 1
        print(got.decode(errors="replace"))
    elif a.command == "scan":
        start, end = [*x, None, None][:2]
        rows = scan.store_range(store.view(now=a.now, start=start, end=end), start, end, a.reverse)
        for r in (rows if a.limit is None else rows.limit(a.limit)).toLocalIterator():
            print(bytes(r.key).decode(errors="replace"), bytes(r.val).decode(errors="replace"), sep="\t")
    elif a.command == "compact":
        store.compact_all()
    else:
        for r in store.stats().orderBy("level").toLocalIterator():
            print(*r, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
