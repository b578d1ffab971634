"""DataFrame to DataFrame operators. Every one of them works on all matches and players at once.

No operator forces a join strategy: sizes are judged by Spark's file statistics and, at run time,
by adaptive execution, which broadcasts a side only when it measured it as small and splits
skewed partitions of shuffled joins.
"""
