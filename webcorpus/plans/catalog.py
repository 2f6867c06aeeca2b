"""All registered queries (importing a module registers its queries)."""

from . import q_links  # noqa: F401
from . import q_fetchlog  # noqa: F401
from . import q_media  # noqa: F401
from . import q_markdown  # noqa: F401
from . import q_discovery  # noqa: F401
from . import q_reports  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
