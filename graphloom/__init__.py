"""graphloom: knowledge-graph analytics and document processing as Spark plans."""
