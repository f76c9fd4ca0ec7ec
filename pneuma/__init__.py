"""Clinical report analytics on Spark; the text-corpus operators live in ``pneuma.llm``."""
