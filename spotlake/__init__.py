"""spotlake: signal-report analytics as PySpark DataFrame, SQL and streaming operators."""
