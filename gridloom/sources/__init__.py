"""Feed schemas, layer readers and writers, catalog and warehouse tables."""
