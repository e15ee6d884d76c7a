"""Record curation, group timelines, splits and score evaluation as Spark jobs."""
