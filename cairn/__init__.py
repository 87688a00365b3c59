"""cairn: record linkage on Spark - normalization, blocking, reranking, pair features, decisions and their audits."""
