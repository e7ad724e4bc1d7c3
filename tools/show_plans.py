"""Print the physical plans (operator tree, long expressions cut) of
selected queries: the evidence for partial aggregation, pushed-down scans,
bounded windows and broadcast decisions.

    python tools/show_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def trimmed(plan: str, width: int = 150) -> str:
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m.group()):02X}", line)
        out.append(line if len(line) <= width else line[: width - 3] + "...")
    return "\n".join(out)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from logweave.plans import queries as Q
    from logweave.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=16,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="logweave-plans-")})
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        df = Q.QUERIES[n](spark, sf_dir)
        execution = df._jdf.queryExecution()
        execution.toRdd().count()  # runs this very plan, so that AQE's last version is shown
        plan = execution.executedPlan().toString().split("+- == Initial Plan ==")[0]
        print(f"### {n}\n\n```\n{trimmed(plan)}\n```\n")


if __name__ == "__main__":
    main(sys.argv)
