"""Report plans over graded responses, adapter views and registered queries."""
