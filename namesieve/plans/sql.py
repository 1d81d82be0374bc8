"""DuckDB SQL of all named queries."""

from __future__ import annotations

from namesieve.plans import files_oracle, learned_oracle, oracle

SQL: dict[str, str] = {**oracle.SQL, **files_oracle.SQL, **learned_oracle.SQL}
