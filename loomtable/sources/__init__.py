"""Sources and sinks: columnar batches, the batch envelope and binary copy streams."""
