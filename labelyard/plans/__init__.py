from .panel import Panel, run_arms, run_panel, score_panel, system_rows  # noqa: F401
from .transfer import schema_swap, supervised_transfer  # noqa: F401
