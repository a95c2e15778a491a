"""python -m loomline SCRIPT_PATH OUTPUT_PATH EMPLOYEE_CODE"""

from __future__ import annotations

import sys

from loomline.runner import run_lineage
from loomline.session import session


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    found = run_lineage(session(), *args)
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
