"""Compare registered queries with their SQL: python tests/check.py SF_DIR [module or query ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from promptweir import registry  # noqa: E402
from promptweir.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for module in registry.MODULES:
        for name, query in module.QUERIES.items():
            if wanted and module.__name__.split(".")[-1] not in wanted and name not in wanted:
                continue
            start = time.time()
            try:
                print(name, str(compare(spark, db, sf_dir, query, module.ORACLES.get(name)))[:1500], flush=True)
            except Exception as error:  # noqa: BLE001
                print(name, "ERROR", round(time.time() - start, 1), str(error)[:1200], flush=True)
                if "-v" in wanted:
                    traceback.print_exc()


if __name__ == "__main__":
    main()
