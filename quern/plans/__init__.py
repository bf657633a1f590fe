"""plans of quern."""
