"""Analysis specs and the view that queries run on."""
