"""quillmesh: document-graph and vector retrieval as Spark plans."""
