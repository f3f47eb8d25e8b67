"""lectern: a Spark-first engine for stylometric text analytics at corpus scale."""
