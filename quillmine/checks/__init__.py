"""Checked queries over the driver tables, one per operator id."""


def all_checked():
    from quillmine.checks import registry

    for module in MODULES:
        __import__(f"quillmine.checks.{module}")
    return registry.CHECKED


MODULES = ("page_queries", "retrieve_queries", "link_queries", "response_queries", "plan_queries")
