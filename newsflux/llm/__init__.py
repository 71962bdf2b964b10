"""Operators of a large-scale training-data pipeline.

One module per operator (``op1_*`` .. ``op13_*``), their registered queries in
``queries.py`` and the DuckDB oracles in ``oracle.py``. Nothing else in the
library imports this subpackage.
"""
