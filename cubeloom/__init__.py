"""cubeloom: statistical cubes, classifications and query sets as Spark jobs."""
