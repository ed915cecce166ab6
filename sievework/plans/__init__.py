

from .. import registry  # noqa: F401  it loads the modules of queries, whichever of them is asked for first
