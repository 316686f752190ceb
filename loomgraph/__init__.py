"""loomgraph: knowledge-graph analytics and text pipelines as PySpark DataFrame operators."""
