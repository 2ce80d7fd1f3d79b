"""Sources of workbooks."""
