"""gristmill: posting analytics and corpus operators as Spark jobs."""
