"""python -m corpusmill QUERY DATA [OUT]: run a registered query and show it, or write it as Parquet."""

from __future__ import annotations

import sys

from corpusmill.plans import registry
from corpusmill.session import get_spark


def main(args: list[str]) -> int:
    registry.load()
    if len(args) < 2 or args[0] not in registry.QUERIES:
        print(__doc__, "\nQueries:", *sorted(registry.QUERIES), sep="\n  ")
        return 1
    out = registry.QUERIES[args[0]](get_spark(), args[1])
    if len(args) > 2:
        out.write.parquet(args[2])
    else:
        out.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
