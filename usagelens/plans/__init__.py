"""Reports and views assembled from the operators."""

from .history import enhanced_history, tool_statements
from .node_cost import node_cost_detail, node_cost_report
from .saved_views import create_views, view_texts
from .views import build_reports, build_views, register_views, save_views

__all__ = ["build_reports", "build_views", "create_views", "enhanced_history", "node_cost_detail", "node_cost_report", "register_views", "save_views", "tool_statements", "view_texts"]
