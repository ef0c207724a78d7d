"""Sources and sinks: driver-table adapters, typed loaders, files, model bundles."""
