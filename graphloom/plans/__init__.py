"""Plans over the driver tables; ``load_queries`` fills the registry."""


def load_queries() -> None:
    import importlib

    for name in QUERY_MODULES:
        importlib.import_module(f"graphloom.plans.{name}")


QUERY_MODULES = ("catalog_queries", "graph_queries", "data_queries", "stream_queries", "upkeep_queries", "search_queries", "index_queries")
