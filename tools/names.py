"""Names of the queries one catalogue module registers."""

import importlib
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from retentia.catalog import registry  # noqa: E402

module = importlib.import_module(f"retentia.catalog.{sys.argv[1]}")
own = [n for n in registry.QUERIES if getattr(getattr(module, n, None), "__module__", "") == module.__name__]
print(" ".join(own))
