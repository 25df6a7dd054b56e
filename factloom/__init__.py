"""Evidence analytics as Spark jobs: snapshot merges, ledgers, three-valued status, diffs, text and graphs."""
