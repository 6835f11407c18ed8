"""wattline: market-telemetry feeds as Spark DataFrames.

Main entry points:

* ``sources.lines.read_lines`` / ``sources.archives`` — feed text from files or ZIP archives
* ``plans.scada.scada_series`` / ``plans.dispatch.dispatch_series`` — typed series
* ``plans.archive_plans.scada_from_archives`` — catalog → archives → series for many days
* ``operators.summary`` — summaries and flag breakdowns per (unit, market day)
* ``operators.series`` — chart-ready shaping; ``sinks.writers`` — CSV / Parquet / JSON
* ``sources.registry`` — unit registry; ``operators.logstats`` — request-log statistics
* ``api`` — endpoint-shaped views
"""

__version__ = "0.1.0"
