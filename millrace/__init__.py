"""millrace: event-stream loading and training-data preparation as Spark jobs."""
